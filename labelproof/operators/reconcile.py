"""Duplicates, human corrections and shelf confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.operators.ingredients import severity
from labelproof.operators.skew import HOT_KEYS, first_rows, join_key_stats
from labelproof.rules.labels import (
    APTO, REVISAR, SEVERITY, SRC_DUPLICATE, SRC_HUMAN, SRC_NONE,
)


def duplicate_key(brand: Column, name: Column) -> Column:
    """Key of products with the same brand and name; null without a name."""
    key = T.norm_name(name)
    return F.when(key != "", F.concat(T.norm_name(brand), F.lit("\u0001"), key))


def reconcile_duplicates(products: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Lower the members of a duplicate group to its worst grounded verdict.

    Unresolved members only move to bad news. The groups are aggregated before
    any row is moved, and only groups with something to say are joined back.
    """
    df = products.withColumn("_key", duplicate_key(F.col("marca"), F.col("nombre")))
    grounded = (F.col("fuente_decision") != SRC_NONE) & (F.col("estado") != REVISAR)
    level = F.when(grounded, severity(F.col("estado")))
    firsts = [
        F.min(F.when(grounded & (F.col("estado") == state), F.col("ean"))).alias(f"_first_{rank}")
        for state, rank in SEVERITY.items()
    ]
    groups = (
        df.filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.count("*").alias("_members"), F.max(level).alias("_level"), *firsts)
        .filter((F.col("_members") >= 2) & F.col("_level").isNotNull())
        .select(
            "_key",
            "_members",
            "_level",
            F.coalesce(
                *[
                    F.when(F.col("_level") == rank, F.col(f"_first_{rank}"))
                    for rank in SEVERITY.values()
                ]
            ).alias("_worst_ean"),
        )
    )
    df = join_key_stats(df, groups, "_key", "_members", F.col("ean"), hot_keys)
    states = F.when(F.col("_level") == 0, APTO)
    for state, rank in SEVERITY.items():
        states = states.when(F.col("_level") == rank, state)
    lower = F.when(F.col("estado") == REVISAR, F.col("_level") > 0).otherwise(
        severity(F.col("estado")) < F.col("_level")
    )
    change = F.coalesce(lower & (F.col("ean") != F.col("_worst_ean")), F.lit(False))
    reason = F.concat(
        F.lit("Mismo nombre y marca que el EAN "), F.col("_worst_ean"),
        F.lit(", clasificado como "), states,
        F.lit(
            " con evidencia directa; ante la discrepancia entre presentaciones "
            "se aplica el criterio más restrictivo."
        ),
    )
    return (
        df.withColumn("_change", change)
        .withColumn("_state", states)
        .withColumn("motivo", F.when(F.col("_change"), reason).otherwise(F.col("motivo")))
        .withColumn(
            "estado", F.when(F.col("_change"), F.col("_state")).otherwise(F.col("estado"))
        )
        .withColumn(
            "fuente_decision",
            F.when(F.col("_change"), SRC_DUPLICATE).otherwise(F.col("fuente_decision")),
        )
        .withColumn("confianza", F.when(~F.col("_change"), F.col("confianza")))
        .drop("_key", "_level", "_worst_ean", "_change", "_state")
    )


def apply_corrections(products: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human verdicts replace the automatic ones; both sides have unique codes."""
    fixes = corrections.select(
        "ean", F.col("estado").alias("_estado"), F.col("revisor").alias("_revisor")
    )
    fixed = F.col("_estado").isNotNull()
    reason = F.concat(F.lit("Revisado y corregido a mano por "), F.col("_revisor"))
    return (
        products.join(fixes, "ean", "left")
        .withColumn("estado", F.coalesce("_estado", "estado"))
        .withColumn(
            "fuente_decision", F.when(fixed, SRC_HUMAN).otherwise(F.col("fuente_decision"))
        )
        .withColumn("motivo", F.when(fixed, reason).otherwise(F.col("motivo")))
        .withColumn("confianza", F.when(~fixed, F.col("confianza")))
        .drop("_estado", "_revisor")
    )


def confirmed_chains(shelf: DataFrame) -> DataFrame:
    """Sorted distinct chains per code: ``ean, cadenas``. Chains are few."""
    return (
        shelf.select("ean", "cadena")
        .distinct()
        .groupBy("ean")
        .agg(F.array_sort(F.collect_set("cadena")).alias("cadenas"))
    )


def confirm_chains(products: DataFrame, shelf: DataFrame) -> DataFrame:
    """Products with the chains that sell them, null for none."""
    return products.join(confirmed_chains(shelf), "ean", "left")


def effective_corrections(edits: DataFrame, current: DataFrame) -> DataFrame:
    """Latest edit per code that differs from the current verdict.

    ``edits`` has ``ean, estado, revisor, orden``; choosing the current verdict
    again takes the correction back.
    """
    order = [F.desc_nulls_last(c) for c in ("orden", "estado", "revisor")]
    last = first_rows(edits.select("ean", F.struct("orden", "estado", "revisor").alias("_last"), "orden", "estado", "revisor"), "ean", order)
    last = last.select("ean", "_last")
    now = current.select("ean", F.col("estado").alias("estado_actual"))
    return (
        last.join(now, "ean")
        .filter(F.col("_last.estado") != F.col("estado_actual"))
        .select(
            "ean",
            "estado_actual",
            F.col("_last.estado").alias("estado_corregido"),
            F.col("_last.revisor").alias("revisor"),
            F.col("_last.orden").alias("orden"),
        )
    )
