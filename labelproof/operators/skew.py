"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# So many of the heaviest keys are joined by broadcast.
HOT_KEYS = 1000
_ROW_BITS = 33


def join_key_stats(
    rows: DataFrame,
    stats: DataFrame,
    key: str,
    weight: str,
    spread: Column,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join of ``rows`` with one row per key, safe for hot and null keys.

    ``weight`` counts the rows of each key. The ``hot_keys`` heaviest keys go by
    broadcast, a list of fixed length at any size; every other key holds less
    than one part in ``hot_keys`` of the rows. Rows of those keys, and rows with
    a null key, then take a key of their own in the shuffle join that serves all
    other keys, instead of meeting in one task.
    """
    values = [c for c in stats.columns if c not in (key, weight)]
    packed = F.struct(*values)
    hot = stats.filter(F.col(key).isNotNull()).orderBy(F.desc(weight), key).limit(hot_keys)
    hot = hot.select(F.col(key).alias("_hot_key"), packed.alias("_hot"))
    rest = stats.select(F.col(key).alias("_rest_key"), packed.alias("_rest"))
    tagged = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    regular = F.col("_hot_key").isNull() & F.col(key).isNotNull()
    tagged = tagged.withColumn(
        "_join_key",
        F.when(regular, F.col(key)).otherwise(F.concat(F.lit("\u0000"), spread)),
    )
    joined = tagged.join(rest, F.col("_join_key") == F.col("_rest_key"), "left")
    found = F.when(F.col("_hot_key").isNotNull(), F.col("_hot")).otherwise(F.col("_rest"))
    return joined.select(
        *rows.columns, found.alias("_found")
    ).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in values])


def first_rows(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order.

    The filter on the row number lets every input task cut a key to one row
    before the shuffle, whatever the types of the columns.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = f"file:///tmp/checkpoints/labelproof-{os.getpid()}"
    return folder.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, by columns, and read from there.

    Later steps read only the columns they need, and a lost executor loses no
    rows.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Number all rows 0, 1, 2, … in a total order without a single-task window.

    Rows are range partitioned and numbered inside their partition; the row
    counts of the partitions, one per shuffle partition, give the offsets.
    The numbered rows are written, so the offsets fit them even when an
    executor is lost between the two uses.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = reliable(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_row"), _ROW_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_offset") + local).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )
