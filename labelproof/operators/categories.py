"""Category of a product from tags, name or shelf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.patterns import any_of, let, lookup
from labelproof.rules import categories as C
from labelproof.rules import rows, words

TAG_RULES = [(name, words(parts)) for name, parts in rows(C.TAG_RULES, 2)]
NAME_RULES = rows(C.NAME_RULES, 2)
SHELF_RULES = rows(C.SHELF_RULES, 2)
ANIMAL = words(C.ANIMAL_CATEGORIES)


def from_tags(tags: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """First rule with a fragment inside any tag body; null without one.

    The bodies are joined by a separator no fragment holds, so a rule is one
    pattern over one text.
    """
    rules = TAG_RULES if rules is None else rules
    bodies = F.array_join(F.transform(tags, lambda t: T.tag_body(F.lower(t))), "\u0001")

    def first(text: Column) -> Column:
        found = F.lit(None).cast("string")
        for name, fragments in reversed(rules):
            found = F.when(text.rlike(any_of(fragments)), F.lit(name)).otherwise(found)
        return found

    return let(bodies, first)


def from_name(
    name: Column,
    rules: list[tuple[str, str]] | None = None,
    animal: list[str] | None = None,
    plant_based: str = C.PLANT_BASED,
) -> Column:
    """First rule found in the name; animal ones are skipped for plant products."""
    rules = NAME_RULES if rules is None else rules
    animal = ANIMAL if animal is None else animal

    def first(text: Column) -> Column:
        is_plant = text.rlike(rf"(?iU)\b(?:{plant_based})")
        found = F.lit(None).cast("string")
        for category, pattern in reversed(rules):
            test = text.rlike(rf"(?iU)\b(?:{pattern})")
            test = test & ~is_plant if category in animal else test
            found = F.when(test, F.lit(category)).otherwise(found)
        return F.when(text != "", found)

    return let(F.trim(T.fold_compatible(name)), first)


def from_shelf(shelf: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """Category of an unambiguous shelf label; null for the others."""
    return lookup(SHELF_RULES if rules is None else rules, F.trim(T.fold_compatible(shelf)))


def final(tags: Column, name: Column, shelf: Column) -> Column:
    """Tags, then name, then shelf, then the rest category."""
    return F.coalesce(from_tags(tags), from_name(name), from_shelf(shelf), F.lit(C.OTHER))


def domain() -> list[str]:
    """All category names in rule order, the rest category last."""
    ordered = dict.fromkeys([n for n, _ in TAG_RULES] + [n for n, _ in NAME_RULES])
    return [*ordered, C.OTHER]
