"""Helpers of this subpackage: tables, the shared folder, word patterns, the split of labelled rows."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that separate words, as a class for Java's, Python's and RE2's patterns alike.
SPACES = r"[\x20\x09-\x0D]"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That serves local sessions started elsewhere; a cluster gets the package installed or by
    --py-files.
    """
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Where it is unset, a local session gets one of its own; a cluster session is refused,
    since a folder of one machine would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/labelproof-{os.getpid()}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows of `frame`, written to the shared folder once and read from there."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def held_out(doc_id: Column) -> Column:
    """Rows kept for the measurement of a model: crc32 of the id's digits leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
