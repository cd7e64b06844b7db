"""Counts and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions.display import percentage, round_ratio
from labelproof.operators.skew import first_rows
from labelproof.operators.verdict import has_tag
from labelproof.rules import rows, words
from labelproof.rules.labels import (
    COVERAGE_STRONG, COVERAGE_WEAK, REVISAR, SOURCE_GROUPS,
)

RESOLVING_TAGS = ["en:vegan", "en:non-vegan", "en:vegetarian", "en:non-vegetarian"]


def counts_by(products: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Row counts of several columns in one pass: ``tipo, valor, n``."""
    pairs = F.array(
        *[F.struct(F.lit(kind).alias("tipo"), col.alias("valor")) for kind, col in kinds.items()]
    )
    return (
        products.select(F.explode(pairs).alias("_p"))
        .filter(F.col("_p.valor").isNotNull())
        .groupBy(F.col("_p.tipo").alias("tipo"), F.col("_p.valor").alias("valor"))
        .agg(F.count("*").alias("n"))
    )


def report(decided: DataFrame) -> DataFrame:
    """Evidence coverage of judged candidates, one row, one pass."""

    def filled(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""

    tagged = F.coalesce(F.size("off_tags"), F.lit(0)) > 0
    seals = F.split(F.coalesce("ficha_sellos", F.lit("")), ",")
    analysed = F.coalesce(
        F.arrays_overlap("off_analysis", F.array(*[F.lit(t) for t in RESOLVING_TAGS])),
        F.lit(False),
    )
    counted = decided.agg(
        F.count("*").alias("muestra"),
        F.count_if(filled("off_text") | tagged | filled("ficha_ingredientes")).alias(
            "con_ingredientes"
        ),
        F.count_if(filled("off_text")).alias("con_texto_ingredientes"),
        F.count_if(tagged).alias("con_taxonomia"),
        F.count_if(analysed).alias("con_analisis_resuelto"),
        F.count_if(has_tag(F.col("off_labels"), "en:vegan")).alias("con_label_vegan"),
        F.count_if(filled("ficha_ingredientes")).alias("con_ingredientes_super"),
        F.count_if(has_tag(seals, "vegan")).alias("con_sello_vegano_super"),
        F.count_if(F.col("rnpa").isNotNull()).alias("certificados"),
        F.count_if(F.col("decision.estado") != REVISAR).alias("resueltos"),
        F.count_if(F.col("decision.estado") == REVISAR).alias("en_revisar"),
    )
    total = F.greatest("muestra", F.lit(1))
    return counted.select(
        "*",
        round_ratio(F.col("con_ingredientes") * 100, total, 2).alias(
            "cobertura_ingredientes_pct"
        ),
        round_ratio(F.col("resueltos") * 100, total, 2).alias("tasa_resolucion_pct"),
    )


def band(coverage_pct: Column) -> Column:
    """Reading of the ingredient coverage against the two thresholds."""
    return (
        F.when(coverage_pct > COVERAGE_STRONG * 100, "alcanza para entrenar")
        .when(coverage_pct < COVERAGE_WEAK * 100, "manda la heuristica de nombre")
        .otherwise("viable con poco dato")
    )


def source_groups(products: DataFrame, source: str) -> DataFrame:
    """Products per source group with their share; empty groups show zero."""
    groups = rows(SOURCE_GROUPS, 2)
    parts = [F.count("*").alias("total")] + [
        F.count_if(F.col(source).isin(words(sources))).alias(f"g{i}")
        for i, (_, sources) in enumerate(groups)
    ]
    stack = ", ".join(f"{i}, g{i}" for i in range(len(groups)))
    listed = products.agg(*parts).selectExpr(
        "total", f"stack({len(groups)}, {stack}) AS (orden, n)"
    )
    title = F.get(F.array(*[F.lit(name) for name, _ in groups]), F.col("orden"))
    return listed.select(
        "orden", title.alias("grupo"), "n", percentage(F.col("n"), F.col("total")).alias("parte")
    )


def load_gap(reported: Column, seen: Column) -> Column:
    """Rows a paged load is still short of; an unknown total counts as none."""
    return F.greatest(F.lit(0), F.coalesce(reported, F.lit(0)) - seen)


def lowest_price(rows_: DataFrame, key: str, price: str, tie: list[str]) -> DataFrame:
    """One row per code: the lowest price, missing prices last."""
    others = [c for c in rows_.columns if c not in (key, price, *tie)]
    order = [F.col(price).isNull(), *[F.asc_nulls_first(c) for c in (price, *tie, *others)]]
    return first_rows(rows_, key, order).select(key, price, *tie, *others)
