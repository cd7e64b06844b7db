"""Review queues and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators.skew import HOT_KEYS, join_key_stats
from labelproof.rules.labels import APTO, NAME_ONLY_SOURCES, REVISAR


def queue(
    products: DataFrame, risk: bool = False, limit: int | None = None, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Rows to review, heaviest brand first, with the brand's row count as ``peso``.

    The plain queue holds the unresolved rows; the risk queue the ``apto`` ones
    that only the name supports. Missing brands form one group, whose rows
    never meet in one task.
    """
    name_only = F.col("fuente_decision").isin(NAME_ONLY_SOURCES)
    wanted = (F.col("estado") == APTO) & name_only if risk else F.col("estado") == REVISAR
    rows = products.filter(wanted).withColumn("_brand", F.coalesce("marca", F.lit("")))
    weights = rows.groupBy("_brand").agg(
        F.count("*").alias("_n"), F.count("*").alias("peso")
    )
    weighed = join_key_stats(rows, weights, "_brand", "_n", F.col("ean"), hot_keys)
    ordered = weighed.drop("_brand").orderBy(
        F.desc("peso"), F.asc_nulls_first("marca"), F.asc("nombre"), F.asc("ean")
    )
    return ordered if limit is None else ordered.limit(limit)


def seeded_sample(rows: DataFrame, key: Column, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows in a repeatable order drawn from the key and the seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)
