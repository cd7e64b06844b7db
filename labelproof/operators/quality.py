"""Relevance filters, cache freshness and fetch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.patterns import any_of, let
from labelproof.operators.skew import dense_positions, join_key_stats
from labelproof.rules import relevance as R
from labelproof.rules import rows, words
from labelproof.rules.labels import FAILURE_STREAK, PHANTOM_SOURCES

EXCLUDED = rows(R.EXCLUDED_CODES, 2)


def other_script(name: Column, script: str = R.OTHER_SCRIPTS) -> Column:
    """True where the name holds a character of the class."""
    return F.coalesce(name.rlike(script), F.lit(False))


def bad_length(ean: Column) -> Column:
    """True for a code whose length is none of a real bar code; null passes."""
    present = ean.isNotNull() & (ean != "")
    return present & ~F.length(ean).isin(R.CODE_LENGTHS)


def is_non_food(
    name: Column,
    word_list: list[str] | None = None,
    phrases: list[str] | None = None,
) -> Column:
    """True where the name holds a non-food word or phrase."""
    word_list = words(R.NON_FOOD_WORDS) if word_list is None else word_list
    phrases = words(R.NON_FOOD_PHRASES) if phrases is None else phrases
    hit = let(
        T.fold_compatible(name),
        lambda text: T.has_word(text, word_list) | text.rlike(any_of(phrases)),
    )
    return F.coalesce(hit, F.lit(False))


def exclusion_reason(
    name: Column, ean: Column, script: str = R.OTHER_SCRIPTS, **lists
) -> Column:
    """First reason to leave a row out, in readable form; null keeps it."""
    return (
        F.when(
            other_script(name, script),
            "nombre en un alfabeto que no se usa en el comercio argentino "
            "(posible país mal etiquetado en origen)",
        )
        .when(
            bad_length(ean),
            F.concat(
                F.lit("el código '"), ean, F.lit("' no tiene una longitud de EAN/UPC real")
            ),
        )
        .when(
            is_non_food(name, **lists),
            "el nombre corresponde a un producto que no es un alimento",
        )
    )


def exclusion_class(reason: Column) -> Column:
    """Short class of an exclusion reason."""
    return (
        F.when(reason.contains("alfabeto"), "alfabeto")
        .when(reason.contains("no es un alimento"), "no_alimento")
        .when(reason.isNotNull(), "ean_invalido")
    )


def is_phantom(tags: Column, ingredients: Column, chains: Column, source: Column) -> Column:
    """True where none of the four signals of a product is there."""
    return (
        (F.coalesce(F.size(tags), F.lit(0)) <= 0)
        & (F.trim(F.coalesce(ingredients, F.lit(""))) == "")
        & (F.coalesce(F.size(chains), F.lit(0)) <= 0)
        & ~F.coalesce(source.isin(PHANTOM_SOURCES), F.lit(False))
    )


def drop_excluded(df: DataFrame, ean: str, codes: list[str] | None = None) -> DataFrame:
    """Rows whose code is not on the exclusion list."""
    codes = [code for code, _ in EXCLUDED] if codes is None else codes
    return df.filter(~F.coalesce(F.col(ean).isin(codes), F.lit(False)))


def is_food_branch(name: Column) -> Column:
    """True where a shop branch name holds a food stem."""
    return F.coalesce(T.fold(name).rlike(any_of(words(R.FOOD_STEMS))), F.lit(False))


def cache_is_fresh(asked: Column, now: Column, ttl_days: int) -> Column:
    """True where the answer is not older than the time to live; null is stale."""
    limit = now - F.make_dt_interval(F.lit(ttl_days))
    return F.coalesce(asked >= limit, F.lit(False))


def pending_keys(wanted: DataFrame, cache: DataFrame, key: str, fresh: Column) -> DataFrame:
    """Distinct wanted keys without a fresh answer; misses count as answers."""
    valid = cache.filter(fresh).select(key).distinct()
    return wanted.select(key).distinct().join(valid, key, "left_anti")


def fetch_outcome(status: Column, valid_json: Column, found: Column) -> Column:
    """What a response log entry says: answered, confirmed absent or no answer."""
    return (
        F.when(status.isNull() | status.isin(429, 500, 502, 503, 504), "no_contesto")
        .when(~status.isin(200, 206), "no_la_tiene")
        .when(~F.coalesce(valid_json, F.lit(False)), "no_contesto")
        .when(~F.coalesce(found, F.lit(False)), "no_la_tiene")
        .otherwise("respondio")
    )


def chunk_summaries(rows: DataFrame, run: str, nth: str, failed: Column, streak: int, chunk: int) -> DataFrame:
    """Per run and chunk: ``_first, _rows, _lead, _trail`` and the end of the first streak inside, ``_inner``.

    Only the places of the successes are gathered, at most ``chunk`` of them.
    """
    place = F.col(nth)
    grouped = rows.groupBy(run, F.floor(place / chunk).cast("bigint").alias("_chunk")).agg(
        F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_rows"),
        F.sort_array(F.collect_list(F.when(~failed, place))).alias("_ok"),
    )
    last_ok = F.array_max("_ok")
    next_ok = lambda i: F.coalesce(F.get("_ok", i + 1), F.col("_last") + 1)
    ends = F.transform("_ok", lambda p, i: F.when(next_ok(i) - p > streak, p + streak))
    return grouped.select(
        run, "_chunk", "_first", "_rows",
        F.coalesce(F.array_min("_ok") - F.col("_first"), F.col("_rows")).alias("_lead"),
        F.coalesce(F.col("_last") - last_ok, F.col("_rows")).alias("_trail"),
        F.array_min(ends).alias("_inner"),
    )


def first_streaks(summaries: DataFrame, run: str, streak: int) -> DataFrame:
    """``run, _end``: the number of the row that completes the first streak, merged from summaries."""
    along = Window.partitionBy(run).orderBy("_chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("_lead") == F.col("_rows")
    # Chunks of failures alone pass on what came before them.
    island = F.coalesce(F.sum((~full).cast("int")).over(before), F.lit(0))
    merged = summaries.withColumn("_island", island)
    inside = Window.partitionBy(run, "_island").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # The chunk that opens an island hands in the failures it ends with; it stands in the island before.
    opened = F.lag(F.when(~full, F.col("_trail"))).over(along)
    merged = merged.withColumn("_opened", opened)
    carried = F.coalesce(F.sum(F.when(full, F.col("_rows"))).over(inside), F.lit(0)) + F.coalesce(
        F.max("_opened").over(Window.partitionBy(run, "_island")), F.lit(0)
    )
    merged = merged.withColumn("_carried", carried)
    reached = (F.col("_carried") < streak) & (F.col("_carried") + F.col("_lead") >= streak) & (F.col("_lead") > 0)
    joined = F.when(reached, F.col("_first") + (streak - F.col("_carried")) - 1)
    ends = merged.select(run, F.least(joined, F.col("_inner")).alias("_end"))
    return ends.groupBy(run).agg(F.min("_end").alias("_end")).filter(F.col("_end").isNotNull())


def cut_failure_streak(
    log: DataFrame,
    run: str,
    pos: str,
    failed: Column,
    streak: int = FAILURE_STREAK,
    chunk: int = 100_000,
) -> DataFrame:
    """Rows of each run up to the end of its first streak of failures.

    Rows are numbered by run and position first, so gaps between positions
    don't matter. Each chunk of those numbers gives a summary of a run's part
    in it: its rows, the failures it begins and ends with, and the first streak
    inside it. Summaries are merged along the run: what a chunk ends with goes
    on through chunks of failures alone, so a streak may be longer than a chunk
    and a run of any length spreads over many tasks. ``run`` is a text column.
    """
    named = log.select(run, pos, failed.cast("boolean").alias("_failed"))
    numbered = dense_positions(named, [F.col(run), F.col(pos)], "_nth")
    cuts = first_streaks(chunk_summaries(numbered, run, "_nth", F.coalesce("_failed", F.lit(False)), streak, chunk), run, streak)
    cuts = cuts.join(numbered.select(run, F.col("_nth").alias("_end"), F.col(pos).alias("_cut")), [run, "_end"]).select(run, "_cut")
    runs = log.groupBy(run).agg(F.count("*").alias("_rows")).join(cuts, run, "left")
    joined = join_key_stats(log, runs, run, "_rows", F.col(pos).cast("string"))
    kept = F.col("_cut").isNull() | (F.col(pos) <= F.col("_cut"))
    return joined.filter(kept).drop("_cut")


def excluded_codes() -> list[str]:
    """Codes left out by hand."""
    return [code for code, _ in EXCLUDED]
