"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column over features of one text. `plan` runs every rule alone on a
bounded sample, measures the seconds it takes and the share of rows it rejects, and orders
the rules by rejections per second. `cascade` then tests them in that order in one CASE, so a
rule runs only on rows that all rules before it let pass. The order changes the cost, never
the verdict: a row is kept when no rule rejects it.

Only built-in functions are used. Defined results: a null, empty or blank text has zero words
and fails `few_words`; repeated rows get the same verdict each; an empty table gives no rows;
other columns are passed on, and helper columns carry a prefix that keeps them apart from the
caller's.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import SPACES, words_of

SYMBOLS = r"[#*$%&|<>]"
WORDS = "__quality_words"
WINDOWS = "__quality_windows"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules. Shares are in hundredths of the words or lines."""

    least_words: int = 50
    most_repeated: int = 50
    most_symbols: int = 10
    most_same_lines: int = 50
    shortest_mean: int = 3
    longest_mean: int = 10
    least_letters: int = 50


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the word array and the hashes of its three-word windows."""
    words = F.col(WORDS)
    size = F.size(words)
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(size - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return docs.withColumn(WORDS, words_of(F.col(text))).withColumn(WINDOWS, windows)


def n_words() -> Column:
    return F.size(WORDS).cast("long")


def word_chars() -> Column:
    """Code points in words."""
    return F.length(F.array_join(WORDS, "")).cast("long")


def n_symbols(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long")


def _lines(text: str) -> Column:
    return F.filter(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    )


def n_dup_lines(text: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    lines = _lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words() -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Texts without a repeated window end at the distinct count. In the others the windows are
    sorted with their places, equal neighbours give the places covered, and each place adds
    the words that the place before it hasn't covered: n log n in the length of the text.
    """
    windows = F.col(WINDOWS)

    def places(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, i: F.coalesce(x["h"] == F.get(pairs, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(pairs, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(
                starts,
                lambda p, i: F.when(i == 0, F.lit(3)).otherwise(
                    F.least(F.lit(3), p - F.get(starts, i - 1))
                ),
            ),
            F.lit(0),
            lambda total, x: total + x,
        )

    # A transform over a one-element array binds a value once for the lambdas inside.
    pairs = F.array(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    count = F.transform(F.transform(pairs, places), covered)[0]
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(repeated, count).otherwise(F.lit(0)).cast("long")


def letters(text: str = "text") -> Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", ""))


def rules(text: str = "text", limits: Limits = Limits()) -> dict[str, Column]:
    """Rule name to the condition under which it rejects, over a `prepared` frame."""
    return {
        "few_words": n_words() < limits.least_words,
        "symbols": n_symbols(text) * 100 > n_words() * limits.most_symbols,
        "mean_word": (word_chars() < n_words() * limits.shortest_mean)
        | (word_chars() > n_words() * limits.longest_mean),
        "same_lines": n_dup_lines(text) * 100 > F.size(_lines(text)) * limits.most_same_lines,
        "few_letters": letters(text) * 100 < word_chars() * limits.least_letters,
        "repeats": n_repeat_words() * 100 > n_words() * limits.most_repeated,
    }


def plan(
    docs: DataFrame, text: str = "text", conditions: dict[str, Column] | None = None, sample_rows: int = 400
) -> list[tuple[str, float, float]]:
    """(rule, seconds on the sample, share rejected), best rejections per second first.

    The sample holds at most `sample_rows` rows; it fixes only the order of the tests.
    """
    conditions = conditions or rules(text)
    sample = prepared(docs.select(text).limit(sample_rows).repartition(1), text).persist()
    try:
        rows = sample.count()
        measured = []
        for name, rejects in conditions.items():
            tested = sample.agg(F.sum(F.coalesce(rejects, F.lit(True)).cast("long")).alias("n"))
            seconds = []
            for _ in range(2):
                began = time.perf_counter()
                rejected = tested.first()["n"] or 0
                seconds.append(time.perf_counter() - began)
            measured.append((name, min(seconds), rejected / rows if rows else 0.0))
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[1]))


def first_failed(conditions: dict[str, Column], order: list[str]) -> Column:
    """The first rule in the order that rejects the row, null if none does."""
    test = F.when(F.coalesce(conditions[order[0]], F.lit(True)), F.lit(order[0]))
    for name in order[1:]:
        test = test.when(F.coalesce(conditions[name], F.lit(True)), F.lit(name))
    return test


def cascade(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 400) -> DataFrame:
    """`docs` with `failed_rule` (null where none rejects) and `kept`."""
    conditions = rules(text, limits)
    order = [name for name, _, _ in plan(docs, text, conditions, sample_rows)]
    return (
        prepared(docs, text)
        .withColumn("failed_rule", first_failed(conditions, order))
        .withColumn("kept", F.col("failed_rule").isNull())
        .drop(WORDS, WINDOWS)
    )


def measured(docs: DataFrame, text: str = "text", limits: Limits = Limits(), sample_rows: int = 400) -> DataFrame:
    """The base counts of every row and the cascade's verdict on the rows that pass them.

    Rows that fail the base leave the CASE at its first branch; the others go through the
    remaining rules in the planned order. The counts are needed for every row, so the rules
    that rest on them read the count instead of the text.
    """
    conditions = rules(text, limits)
    rest = [k for k in conditions if k not in ("few_words", "repeats")]
    order = [name for name, _, _ in plan(docs, text, {k: conditions[k] for k in rest}, sample_rows)]
    counted = prepared(docs, text).withColumns(
        {
            "n_words": n_words(),
            "word_chars": word_chars(),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": n_repeat_words(),
        }
    )
    words, chars = F.col("n_words"), F.col("word_chars")
    on_counts = conditions | {
        "symbols": F.col("n_symbols") * 100 > words * limits.most_symbols,
        "mean_word": (chars < words * limits.shortest_mean) | (chars > words * limits.longest_mean),
        "same_lines": (F.col("n_dup_lines") > 0) & conditions["same_lines"],
        "few_letters": letters(text) * 100 < chars * limits.least_letters,
    }
    base = (words < limits.least_words) | (F.col("n_repeat_words") * 100 > words * limits.most_repeated)
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        failed = failed.when(on_counts[name], F.lit(name))
    return (
        counted.withColumn("base_failed", base)
        .withColumn("failed_rule", failed)
        .withColumn("kept", F.col("failed_rule").isNull())
        .drop(WORDS, WINDOWS)
    )


# The same verdicts in DuckDB's SQL, over the view `documents`.
CHECK = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t,
    list_filter(regexp_split_to_array(t, '{SPACES}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), p AS (
  SELECT k, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w
), q AS (
  SELECT k, i, a, lead(a, 1) OVER r AS b, lead(a, 2) OVER r AS c FROM p WINDOW r AS (PARTITION BY k ORDER BY i)
), g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM q WHERE c IS NOT NULL
), c AS (
  SELECT k, count(DISTINCT i + s) AS n FROM g, (VALUES (0), (1), (2)) AS o(s) WHERE n >= 2 GROUP BY k
), f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters
  FROM w LEFT JOIN c USING (k)
), b AS (
  SELECT *, coalesce(chars, 0) AS word_chars,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > n_words * 10 OR word_chars < n_words * 3
    OR word_chars > n_words * 10 OR n_dup_lines * 100 > n_lines * 50
    OR letters * 100 < word_chars * 50) AS kept
FROM b
"""
