"""Text and key normalisation as native column expressions.

The functions differ in what they strip (canonical or compatibility accents,
punctuation, spaces); each consumer keeps its own one.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelproof.functions.patterns import UNICODE, any_of, let, literals, lookup, matches
from labelproof.rules import lexicon, relevance, words

_SPACES = UNICODE + r"\s+"
# What collapsing changes: single plain spaces stay as they are.
_LOOSE_SPACES = UNICODE + r"\s{2,}|[\s&&[^ ]]"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _decompositions(form: str, starts: list[tuple[int, int]]) -> dict[str, str]:
    """Characters whose decomposition drops to other base characters."""
    table = {}
    for low, high in starts:
        for code in range(low, high):
            char = chr(code)
            split = unicodedata.normalize(form, char)
            base = "".join(c for c in split if unicodedata.category(c) != "Mn")
            if base != char and split != char and base:
                table[char] = base
    return table


_CANONICAL = {
    c: b for c, b in _decompositions("NFD", [(0xC0, 0x2000)]).items() if len(b) == 1
}
_COMPATIBLE = _decompositions("NFKD", [(0xA0, 0x2200), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)])
_COMPATIBLE_ONE = {c: b for c, b in _COMPATIBLE.items() if len(b) == 1}
_COMPATIBLE_MANY = {c: b for c, b in _COMPATIBLE.items() if len(b) > 1}


def _is_ascii(col: Column) -> Column:
    return F.length(col) == F.octet_length(col)


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def collapse(col: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(col, _LOOSE_SPACES, " "))


def blank_to_null(col: Column) -> Column:
    """Collapsed text, null when nothing is left."""
    return F.nullif(collapse(col), F.lit(""))


def strip_accents(col: Column) -> Column:
    """Canonical decomposition without its combining marks."""

    def strip(text: Column) -> Column:
        plain = F.regexp_replace(_translate(text, _CANONICAL), r"\p{Mn}", "")
        return F.when(_is_ascii(text), text).otherwise(plain)

    return let(col, strip)


def strip_compatible(col: Column) -> Column:
    """Compatibility decomposition without its combining marks."""
    pairs = list(_COMPATIBLE_MANY.items())

    def strip(text: Column) -> Column:
        spelled = F.array_join(
            F.transform(F.split(text, ""), lambda c: F.coalesce(lookup(pairs, c), c)), ""
        )
        has_many = text.rlike("[" + "".join(_COMPATIBLE_MANY) + "]")
        single = F.when(has_many, spelled).otherwise(text)
        plain = F.regexp_replace(_translate(single, _COMPATIBLE_ONE), r"\p{Mn}", "")
        return F.when(_is_ascii(text), text).otherwise(plain)

    return let(col, strip)


def fold(col: Column) -> Column:
    """Lower case without canonical accents."""
    return F.lower(strip_accents(col))


def fold_compatible(col: Column) -> Column:
    """Lower case without compatibility accents."""
    return F.lower(strip_compatible(col))


def norm_name(col: Column) -> Column:
    """Key of a product name; null gives the empty key."""
    return F.coalesce(collapse(F.replace(fold(col), F.lit("-"), F.lit(" "))), F.lit(""))


def norm_ingredients(col: Column) -> Column:
    """Ingredient text with additive codes in their spaced form."""
    classes = "|".join(words(lexicon.CLASS_ABBREVIATIONS))

    def spaced(text: Column) -> Column:
        codes = F.regexp_replace(text, UNICODE + r"\b(ins|e)[\s.-]*(\d{3,4})\b", "$1 $2")
        codes = F.regexp_replace(
            codes, UNICODE + rf"\b({classes})[\s.-]+(?!ins\b)(\d{{3,4}})\b", "$1 ins $2"
        )
        # A code has three digits.
        return F.when(matches(text, r"\d{3}"), codes).otherwise(text)

    return collapse(let(F.replace(fold(col), F.lit("_"), F.lit(" ")), spaced))


def norm_registry(col: Column) -> Column:
    """Registry key: letters, digits and single spaces; null gives the empty key."""
    text = F.regexp_replace(fold(col), UNICODE + r"[^a-z0-9\s]", " ")
    return F.coalesce(collapse(text), F.lit(""))


def token_set(col: Column) -> Column:
    """Significant words of a registry text: sorted, distinct, without stop words."""
    long = F.filter(F.split(norm_registry(col), " "), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_except(long, literals(words(relevance.REGISTRY_STOPWORDS))))


def clause_tokens(
    col: Column, start: str = relevance.FLAVOUR_START, end: str = relevance.FLAVOUR_END
) -> Column:
    """Significant words of the flavour clauses of a raw registry text."""
    pattern = rf"(?iuUs){start}(.*?)(?={end}|\z)"
    clauses = F.regexp_extract_all(col, F.lit(pattern), 1)
    tokens = F.flatten(F.transform(clauses, token_set))
    return F.coalesce(F.array_sort(F.array_distinct(tokens)), F.array().cast("array<string>"))


def brand_clean(col: Column) -> Column:
    """Brand spelling without loading noise; null when nothing is left."""
    text = F.regexp_replace(col, UNICODE + r"\A\s+|\s+\z", "")
    text = F.regexp_replace(text, UNICODE + r"(?s)\A\[\s*(['\"])(.*)\1\s*\]\z", "$2")
    text = F.regexp_replace(text, UNICODE + r"\s*,\s*", ", ")
    text = F.regexp_replace(text, UNICODE + r"\s*%\s*\z", "")
    text = F.btrim(F.regexp_replace(text, _SPACES, " "), F.lit(" ,-"))
    return F.nullif(text, F.lit(""))


def brand_key(col: Column) -> Column:
    """Grouping key of a brand: no accents, case or punctuation."""
    text = F.regexp_replace(F.coalesce(brand_clean(col), F.lit("")), "['´’ʼ`]", "")
    return F.trim(F.regexp_replace(fold_compatible(text), "[^a-z0-9]+", " "))


def ean_normalize(col: Column) -> Column:
    """Bar code digits: 8 to 14, with 11 and 12 padded to 13; else null."""

    def expand(text: Column) -> Column:
        number = text.try_cast("double").try_cast("bigint").cast("string")
        exact = F.when(text.rlike(_NUMBER), number)
        return F.when(F.lower(text).contains("e"), exact).otherwise(text)

    def pad(digits: Column) -> Column:
        size = F.length(digits)
        return F.when(size.isin(11, 12), F.lpad(digits, 13, "0")).when(
            size.between(8, 14), digits
        )

    text = let(F.regexp_replace(F.trim(col), r"\.0$", ""), expand)
    return let(F.regexp_replace(text, r"\D", ""), pad)


def price_parse(col: Column) -> Column:
    """Price with a decimal comma or point; null when it is not a number."""
    text = F.replace(col, F.lit(","), F.lit("."))
    return let(text, lambda t: F.when(t.rlike(_NUMBER), t.try_cast("double")))


def slugify(col: Column) -> Column:
    """Address part of a name: at most 70 plain characters."""
    plain = F.regexp_replace(strip_compatible(F.coalesce(col, F.lit(""))), r"[^\x00-\x7F]", "")
    slug = F.btrim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(slug, 1, 70), F.lit("")), F.lit("producto"))


def product_route(ean: Column, name: Column) -> Column:
    """Slug followed by the code that identifies the product."""
    return F.concat_ws("-", slugify(name), ean)


def tag_body(col: Column) -> Column:
    """Taxonomy tag without its language prefix."""
    return F.regexp_replace(col, r"(?s)\A[^:]*:", "")


def tag_text(col: Column) -> Column:
    """Taxonomy tag as ingredient text."""
    return norm_ingredients(F.replace(tag_body(col), F.lit("-"), F.lit(" ")))


def search_key(col: Column) -> Column:
    """Search form of a text: accents and case removed, spaces kept."""

    def strip(text: Column) -> Column:
        plain = F.regexp_replace(_translate(text, _CANONICAL), r"[̀-ͯ]", "")
        return F.lower(F.when(_is_ascii(text), text).otherwise(plain))

    return let(col, strip)


def has_word(col: Column, word_list: list[str]) -> Column:
    """True where one of the words stands between word borders."""
    return matches(col, rf"\b(?:{any_of(word_list)})\b")


def padded_words(col: Column) -> Column:
    """Text between single spaces with punctuation set apart.

    ``contains(padded_words(t), ' w ')`` is then the word-border test for ``w``,
    without a pattern per word.
    """
    apart = F.regexp_replace(col, UNICODE + r"[^\w\s]", " ¦ ")
    return F.concat(F.lit(" "), collapse(apart), F.lit(" "))
