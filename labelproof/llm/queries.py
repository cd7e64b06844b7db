"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.llm import bpe, chat, decontaminate, filter_audit, html, language, pii, quality, secret_scan, sketch, spelling, token_files, toxicity
from labelproof.llm.common import held_out, new_folder, table
from labelproof.llm.tokens import vocabulary

WORD_BPE = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.measured(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    shards = token_files.write(table(spark, folder, "documents"), new_folder(spark, "token-files"), vocabulary(WORD_BPE))
    return token_files.read(spark, shards)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    content = language.dictionaries(docs)
    return language.predicted(docs.select("doc_id", "text"), content).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, vocabulary(WORD_BPE)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = pii.found(docs, pii.fit(docs)).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *(count(k) for k in pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), size=4, percent=80)


def op7_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with another one's last answer."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    pairs = chat.preferences(turns.withColumnRenamed("conv_id", "pair_id"), chat.borrowed(turns).withColumnRenamed("conv_id", "pair_id"))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    pairs = pairs.join(counts, pairs["pair_id"].eqNullSafe(counts["conv_id"]))

    def mask(name: str):
        return F.array_join(F.transform(name, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias(name)

    return pairs.select(
        "conv_id", F.col("common").cast("long").alias("common"), "n_turns", F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"), F.sha2("rejected", 256).alias("rejected_sha256"), mask("chosen_mask"), mask("rejected_mask"),
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, folder, "benchmark"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    rows = html.extracted(pages, html.fit(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audited(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """An owner is a source; each language of it is a repository."""
    rows = secret_scan.scanned(table(spark, folder, "documents"), "source", "lang")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(field: str, value: str):
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    return rows.select(
        "doc_id", *(count("kind", k) for k in secret_scan.BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined("spans").alias("spans"),
        count("status", "live"), count("status", "example"),
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_language": op3_language,
    "op4_bpe": op4_bpe,
    "op5_personal_data": op5_personal_data,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_preferences": op7_preferences,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

CHECKS: dict[str, str] = {
    "op1_quality_rules": quality.CHECK,
    "op7_preferences": chat.CHECK,
    "op9_decontamination": decontaminate.CHECK,
    "op6_near_duplicates": sketch.check_sql(4, 80),
    "op11_filter_audit": filter_audit.CHECK,
    "op12_secret_scan": secret_scan.CHECK,
    "op13_spelling_variants": spelling.CHECK,
}
