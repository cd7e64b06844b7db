"""One spelling per brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.patterns import lookup
from labelproof.operators.skew import HOT_KEYS, join_key_stats, reliable
from labelproof.rules import relevance as R
from labelproof.rules import rows

ALIASES = rows(R.BRAND_ALIASES, 2)


def is_mixed_case(col: Column) -> Column:
    """True for a spelling with both upper and lower case letters."""
    return col.rlike(r"\p{Lu}") & col.rlike(r"\p{Ll}")


def has_accent(col: Column) -> Column:
    """True for a spelling with accent marks."""
    return T.strip_accents(col) != col


def spelling_votes(rows_: DataFrame, brand: str) -> DataFrame:
    """Rows per raw brand spelling, blank ones left out: ``marca, n``."""
    filled = rows_.filter(F.trim(F.col(brand)) != "")
    return filled.groupBy(F.col(brand).alias("marca")).agg(F.count("*").alias("n"))


def canonical(votes: DataFrame) -> DataFrame:
    """Spelling to show per brand key: ``clave, canonica``.

    Mixed-case spellings go first when there are any; among those an accented
    one with enough support wins over volume.
    """
    spelled = (
        votes.withColumn("_clean", T.brand_clean(F.col("marca")))
        .filter(F.col("_clean").isNotNull())
        .groupBy(T.brand_key(F.col("_clean")).alias("clave"), "_clean")
        .agg(F.sum("n").alias("_n"))
        .filter(F.col("clave") != "")
        .withColumn("_mixed", is_mixed_case(F.col("_clean")))
    )
    totals = spelled.groupBy("clave").agg(
        F.sum(F.when(F.col("_mixed"), F.col("_n"))).alias("_mixed_total"),
        F.sum("_n").alias("_total"),
    )
    base = F.coalesce("_mixed_total", "_total")
    floor = F.greatest(
        F.lit(R.ACCENT_MIN_COUNT), F.floor(base * F.lit(R.ACCENT_MIN_SHARE))
    )
    order = F.struct(
        F.col("_n"), (-F.length("_clean")).alias("_short"), F.col("_clean")
    )
    candidate = F.col("_mixed") | F.col("_mixed_total").isNull()
    supported = candidate & has_accent(F.col("_clean")) & (F.col("_n") >= floor)
    chosen = spelled.join(totals, "clave").groupBy("clave").agg(
        F.max(F.when(supported, order)).alias("_accented"),
        F.max(F.when(candidate, order)).alias("_any"),
    )
    best = F.coalesce(F.col("_accented._clean"), F.col("_any._clean"))
    return chosen.select(
        "clave", F.coalesce(lookup(ALIASES, F.col("clave")), best).alias("canonica")
    )


def brand_map(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Raw spelling to canonical spelling: ``marca, canonica, n``.

    The secondary source votes only for brands the primary source does not
    know, but all its spellings resolve. ``n`` counts the rows of a spelling.
    Both sources are read once, into one table of spellings with their votes.
    """
    votes = primary.select("marca", "n", F.col("n").alias("_first")).unionByName(
        secondary.select("marca", "n", F.lit(None).cast("bigint").alias("_first"))
    )
    votes = votes.groupBy("marca").agg(F.sum("n").alias("n"), F.sum("_first").alias("_first"))
    votes = votes.withColumn("clave", T.brand_key(F.col("marca"))).filter("clave <> ''")
    known = F.max(F.col("_first").isNotNull()).over(Window.partitionBy("clave"))
    members = reliable(votes.withColumn("_known", known))
    voters = members.filter(~F.col("_known") | F.col("_first").isNotNull())
    chosen = canonical(voters.select("marca", F.when(F.col("_known"), F.col("_first")).otherwise(F.col("n")).alias("n")))
    return members.join(chosen, "clave").select("marca", "canonica", "n")


def apply_map(
    rows_: DataFrame, brand: str, mapping: DataFrame, spread: Column, out: str,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Canonical brand: exact spelling, cleaned spelling, alias, cleaned text.

    The map is written once and read by both look-ups.
    """
    mapping = reliable(mapping)
    exact = mapping.select(
        F.col("marca").alias("_raw"), F.col("canonica").alias("_exact"), F.col("n").alias("_n")
    )
    cleaned = mapping.select(
        F.col("marca").alias("_raw"), F.col("canonica").alias("_cleaned"),
        F.col("n").alias("_n"),
    )
    kept = [c for c in rows_.columns if c != out]
    df = rows_.select(*kept, F.col(brand).alias("_raw"))
    df = join_key_stats(df, exact, "_raw", "_n", spread, hot_keys)
    df = df.withColumn("_clean", T.brand_clean(F.col("_raw"))).drop("_raw")
    # Only spellings the map does not hold take the second look-up.
    df = df.withColumn("_raw", F.when(F.col("_exact").isNull(), F.col("_clean")))
    df = join_key_stats(df, cleaned, "_raw", "_n", spread, hot_keys)
    alias = lookup(ALIASES, T.brand_key(F.col("_clean")))
    value = F.coalesce("_exact", "_cleaned", alias, "_clean")
    return df.withColumn(out, value).drop("_raw", "_exact", "_clean", "_cleaned")


def fill_brand(brand: Column, shelf_brand: Column) -> Column:
    """Source brand, else the trimmed shelf brand; an empty one counts as missing."""
    return F.coalesce(F.nullif(brand, F.lit("")), shelf_brand)
