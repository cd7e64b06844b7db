"""Helpers that turn ordered pattern lists into native CASE expressions.

Patterns are always literals, so every task compiles them once. ``(?U)`` gives
word borders and classes their Unicode meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body(col)`` with ``col`` evaluated once, however often it is used.

    Keeps nested text functions linear in size; without it every use of the
    argument would repeat its whole expression in the plan.
    """
    return F.get(F.transform(F.array(col), body), F.lit(0))


def settled(col: Column) -> Column:
    """The same value, kept as one computed column of its projection.

    A filter on a verdict would otherwise be moved below the projections that
    compute it, and each use of a column on the way would be replaced by its
    whole expression. The test is always true; that it reads a random number
    keeps the optimiser from moving or repeating the value. It is a sum, because
    the optimiser knows the range of the plain number and drops such a test.
    """
    return F.when(F.rand(0) + 1 > 0, col)


def occurs(col: Column, pattern: str) -> Column:
    """True where the pattern occurs in the text, for use inside lambdas.

    Lambdas are not compiled, and there ``rlike`` spells out its pattern anew for
    every text; ``regexp_instr`` only compares it with the last one.
    """
    return F.regexp_instr(col, F.lit(pattern)) > 0


def occurs_sql(var: str, pattern: str) -> str:
    """SQL text of ``occurs``."""
    return f"regexp_instr({var}, {sql_literal(pattern)}) > 0"


def matches(col: Column, pattern: str) -> Column:
    """True where the pattern occurs in the text, word borders by Unicode."""
    return occurs(col, UNICODE + _uncaptured(pattern))


def _uncaptured(pattern: str) -> str:
    """The pattern with groups that keep nothing, so a matcher has none to clear for each text."""
    parts, bracket, i = [], False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            if pattern[i + 1 : i + 2].isdigit() and not bracket:
                return pattern  # it refers to a group
            parts.append(pattern[i : i + 2])
            i += 2
            continue
        if char in "[]":
            bracket = char == "["
        parts.append("(?:" if char == "(" and not bracket and pattern[i + 1 : i + 2] != "?" else char)
        i += 1
    return "".join(parts)


def _branches(pattern: str) -> list[str]:
    """Alternatives of a pattern outside all brackets."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif char in "([":
            depth += 1
        elif char in ")]":
            depth -= 1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _by_letter(branches: list[str]) -> str:
    """Alternation of the branches that tests a common first letter once."""
    groups: dict[str, list[str]] = {}
    for b in dict.fromkeys(branches):
        plain = b[:1].isalnum() and b[1:2] not in ("?", "*", "+", "{")
        groups.setdefault(b[:1] if plain else "", []).append(b)
    others = groups.pop("", [])
    shared = [
        same[0] if len(same) == 1 else f"{letter}(?:{_by_letter([b[1:] for b in same])})"
        for letter, same in groups.items()
    ]
    return "|".join([*shared, *others])


def any_of(patterns: Sequence[str]) -> str:
    """One alternation that matches where any of the patterns does.

    The word border that most alternatives start with is tested once per place
    of the text, not once per alternative, and so is each letter that several
    alternatives have in common.
    """
    branches = [b for p in patterns for b in _branches(_uncaptured(p))]
    at_word = [b[2:] for b in branches if b.startswith(r"\b")]
    others = [b for b in branches if not b.startswith(r"\b")]
    rest = [_by_letter(others)] if others else []
    return "|".join([rf"\b(?:{_by_letter(at_word)})", *rest] if at_word else rest)


def sql_literal(value: str) -> str:
    """Raw SQL string literal of a pattern."""
    if "'" in value:
        raise ValueError("patterns in SQL text hold no quote")
    return f"r'{value}'"


def rank_case(var: str, patterns: Sequence[str]) -> str:
    """SQL text of the zero-based rank of the first pattern found, else null.

    One alternation rejects the texts without any hit. A hit is then looked for
    by halves of the list, so it takes as many tests as the list can be halved.
    SQL text keeps the expression one parse instead of one call per pattern.
    """

    def found(low: int, high: int) -> str:
        return occurs_sql(var, UNICODE + any_of(patterns[low:high]))

    def first(low: int, high: int) -> str:
        """The first rank from low to before high, where one of them is found."""
        if high - low == 1:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {found(low, mid)} THEN {first(low, mid)} ELSE {first(mid, high)} END"

    return f"CASE WHEN {found(0, len(patterns))} THEN {first(0, len(patterns))} END"


def add_field(items: str, fields: list[str], name: str, value: str, nested: bool = False) -> Column:
    """Array of structs with one more field, given as SQL text over ``m``.

    Every stage of the row-local work is such a step over its own element. A
    lambda that read another computed column could get that column's whole
    expression inlined and evaluated once per element.
    """
    kept = ", ".join(f"'{f}', m.{f}" for f in fields)
    step = f"m -> named_struct({kept}, '{name}', {value})"
    if nested:
        return F.expr(f"transform({items}, ms -> transform(ms, {step}))")
    return F.expr(f"transform({items}, {step})")


def first_rank(name: str, patterns: Sequence[str]) -> Column:
    """Rank of the first pattern found in a text column."""
    return F.expr(rank_case(name, patterns))


def literals(values: Sequence[str]) -> Column:
    """Array literal of strings, folded from one text literal."""
    return F.split(F.lit("\u0001".join(values)), "\u0001")


def pick(values: Sequence[str], rank: Column) -> Column:
    """Value of a literal list at a zero-based rank, null outside."""
    return F.get(literals(values), rank)


def lookup(pairs: Sequence[tuple[str, str]], key: Column) -> Column:
    """Value of a fixed key/value list, null for an unknown key."""
    text = "\u0001".join(f"{k}\u0002{v}" for k, v in pairs)
    table = F.str_to_map(F.lit(text), F.lit("\u0001"), F.lit("\u0002"))
    return F.try_element_at(table, key)
