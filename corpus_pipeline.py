"""The training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), calls one operator of the subpackage on all rows that it
is given, and returns the columns of documents; the last one returns ids and digests. `run`
writes every stage's rows to the shared folder and reads them again.

Rows without doc_id pass every stage on the merit of their text: they can't be named as copies, so
dedup keeps them. Rows that repeat an id with another text are documents of their own. Null and empty texts are kept. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import bpe, decontaminate, pii, sketch, toxicity
from labelproof.llm.common import table, written
from labelproof.llm.tokens import vocabulary

WORD_BPE = "word_bpe_49k.json"
TOXIC = 0.3


def _row_key() -> Column:
    """A row's own key, of its id and text; only rows equal in both share it."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    # Rows that repeat an id are told apart by a hash of id and text; it exceeds any usual id.
    repeated = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    repeated = written(repeated, "repeated-ids")
    single = docs.join(repeated, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").cast("long").alias("__key"))
    several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns, _row_key().bitwiseAND(2**62 - 1).bitwiseOR(2**62).alias("__key"))
    keyed = single.unionByName(written(several.dropDuplicates(["__key"]), "repeated-rows"))
    groups = sketch.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, percent=80)
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    keyed = docs.withColumn("__key", _row_key())
    leaks = decontaminate.contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(leaks, "__key", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    model = pii.fit(docs.select("doc_id", "text"))
    masked = pii.redacted(docs, model)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and digests of ids and decoded text."""
    return bpe.encode_decode(docs.select("doc_id", "text"), vocabulary(WORD_BPE)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

# Learned scores, belief propagation and BPE can't be said in SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
