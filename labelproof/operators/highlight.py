"""Marking the ingredient that decided a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.patterns import let

_TRIGGER = r"(?U)^Contiene\s+([^:(,]+?)\s*(?:[:(,]|\z)"


def trigger_term(reason: Column) -> Column:
    """Ingredient named by a reason text; null when it names none."""
    term = F.trim(F.regexp_extract(F.trim(reason), _TRIGGER, 1))
    return let(term, lambda t: F.when((F.length(t) >= 3) & ~F.startswith(F.lower(t), F.lit("ingrediente")), t))


def trigger_spans(text: Column, term: Column) -> Column:
    """Pieces of the text in order: ``struct(texto, resaltado)``.

    Whole-word occurrences of the term, without regard to case and accents, are
    the marked pieces; joined together the pieces give the text back. The plain
    form keeps one character per character of the text, so its positions hold
    for both; a text with detached accent marks is given back unmarked.
    """
    # Each step is evaluated once per text; the lambdas read the step before, not its expression.
    read = F.struct(
        text.alias("text"), T.search_key(text).alias("plain"), F.trim(T.search_key(term)).alias("needle")
    )
    return let(read, _spans)


def _spans(read: Column) -> Column:
    text, plain, needle = read["text"], read["plain"], read["needle"]
    size = F.length(needle)
    whole = F.array(F.struct(text.alias("texto"), F.lit(False).alias("resaltado")))

    def starts(parts: Column) -> Column:
        """Whole-word occurrences from left to right, found by cutting the text at the term."""
        found = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.length(F.call_function("array_join", F.slice(parts, F.lit(1), i), needle)) + 1,
        )
        return F.filter(
            found,
            lambda i: ~F.substring(plain, i - 1, F.least(i - 1, F.lit(1))).rlike("[a-z0-9]")
            & ~F.substring(plain, i + size, F.lit(1)).rlike("[a-z0-9]"),
        )

    def pieces(at: Column) -> Column:
        def pair(i: Column, k: Column) -> Column:
            # The end of the marked piece before.
            before = F.coalesce(F.get(at, k - 1) + size, F.lit(1))
            return F.array(
                F.struct(
                    F.substring(text, before, i - before).alias("texto"),
                    F.lit(False).alias("resaltado"),
                ),
                F.struct(F.substring(text, i, size).alias("texto"), F.lit(True).alias("resaltado")),
            )

        last = F.element_at(at, -1) + size
        tail = F.struct(
            F.substring(text, last, F.length(text)).alias("texto"), F.lit(False).alias("resaltado")
        )
        cut = F.concat(F.flatten(F.transform(at, pair)), F.array(tail))
        return F.when(F.size(at) > 0, F.filter(cut, lambda p: p["texto"] != "")).otherwise(whole)

    quoted = F.concat(F.lit(r"\Q"), needle, F.lit(r"\E"))
    none = (F.coalesce(needle, F.lit("")) == "") | text.rlike(r"[\x{300}-\x{36F}]")
    marked = let(F.split(plain, quoted), lambda parts: let(starts(parts), pieces))
    return F.when(none | ~F.contains(plain, needle), whole).otherwise(marked)
