"""Strict precedence of the evidence of one product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions.patterns import settled
from labelproof.operators import ingredients as I
from labelproof.operators.evidence import analyze_product, resolved, two_sources
from labelproof.operators.names import name_heuristic
from labelproof.rules.labels import (
    APTO, NO_APTO, REVISAR, SRC_ANALYSIS, SRC_MAKER, SRC_NONE, SRC_REGISTRY, SRC_SEAL,
    VEGETARIANO,
)


def _answer(state, source, reason) -> Column:
    return F.struct(
        (state if isinstance(state, Column) else F.lit(state)).alias("estado"),
        (source if isinstance(source, Column) else F.lit(source)).alias("fuente"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("motivo"),
    )


def has_tag(tags: Column, tag: str) -> Column:
    """True where the tag list holds the tag; a missing list holds nothing."""
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def analysis_decision(labels: Column, analysis: Column, present: Column) -> Column:
    """Verdict of the maker's label and of the source's own ingredient analysis."""
    return (
        F.when(
            ~present, _answer(REVISAR, SRC_NONE, "El producto no está en Open Food Facts")
        )
        .when(
            has_tag(labels, "en:vegan"),
            _answer(APTO, SRC_MAKER, "Declarado vegano por el fabricante"),
        )
        .when(
            has_tag(analysis, "en:non-vegan") & has_tag(analysis, "en:vegetarian"),
            _answer(
                VEGETARIANO, SRC_ANALYSIS, "Análisis de ingredientes: vegetariano, no vegano"
            ),
        )
        .when(
            has_tag(analysis, "en:non-vegan"),
            _answer(
                NO_APTO, SRC_ANALYSIS,
                "Análisis de ingredientes (Open Food Facts): no vegano",
            ),
        )
        .when(
            has_tag(analysis, "en:non-vegetarian"),
            _answer(
                NO_APTO, SRC_ANALYSIS,
                "Análisis de ingredientes: contiene ingredientes animales",
            ),
        )
        .when(
            has_tag(analysis, "en:vegan"),
            _answer(
                APTO, SRC_ANALYSIS,
                "Confirmado por análisis de ingredientes (Open Food Facts)",
            ),
        )
        .when(
            has_tag(analysis, "en:vegetarian"),
            _answer(VEGETARIANO, SRC_ANALYSIS, "Análisis de ingredientes: vegetariano"),
        )
        .otherwise(
            _answer(REVISAR, SRC_NONE, "Open Food Facts no pudo determinar el estado")
        )
    )


def certified(ing: Column, source: str, who: Column, granted: Column) -> Column:
    """Certificate verdict, withheld when the product's own list says otherwise."""
    against = resolved(ing) & (ing["estado"] != APTO)
    doubt = F.concat(
        who, F.lit(", pero su propia lista de ingredientes dice lo contrario: "),
        F.lower(ing["motivo"]),
    )
    return F.when(against, _answer(REVISAR, source, doubt)).otherwise(
        _answer(APTO, source, granted)
    )


def agree_or_worse(ing: Column, source: Column, other: Column, analysis: Column) -> Column:
    """Ingredients and source analysis, both resolved: agreement or the worse one."""
    silent = ~has_tag(analysis, "en:vegetarian") & ~has_tag(analysis, "en:non-vegetarian")
    keep = (ing["estado"] == VEGETARIANO) & (other["estado"] == NO_APTO) & silent
    own_worse = I.severity(ing["estado"]) >= I.severity(other["estado"])
    return (
        F.when(
            ing["estado"] == other["estado"],
            _answer(
                ing["estado"], source,
                F.concat(
                    ing["motivo"], F.lit(". Coincide con el análisis de Open Food Facts.")
                ),
            ),
        )
        .when(
            keep,
            _answer(
                VEGETARIANO, source,
                F.concat(
                    ing["motivo"],
                    F.lit(
                        ". Open Food Facts coincide en que no es vegano, "
                        "pero no se pronuncia sobre el estado vegetariano."
                    ),
                ),
            ),
        )
        .otherwise(
            _answer(
                F.when(own_worse, ing["estado"]).otherwise(other["estado"]), source,
                F.concat(
                    ing["motivo"], F.lit(". Open Food Facts dice «"), other["estado"],
                    F.lit("»; ante la discrepancia se toma el criterio más restrictivo."),
                ),
            )
        )
    )


def decide(df: DataFrame, out: str = "decision") -> DataFrame:
    """Add the decision struct of every candidate.

    Reads ``nombre, marca, categoria``, the payload columns ``off_found``,
    ``off_text``, ``off_tags``, ``off_analysis``, ``off_labels``, the sheet
    columns ``ficha_ingredientes``, ``ficha_sellos`` and the registry number
    ``rnpa`` (null without a match). Only rows that nothing else settles go
    through the name rules.
    """
    df = analyze_product(df, "off_text", "off_tags", "_payload")
    df = I.analyze_text(df, "ficha_ingredientes", "_sheet")
    df = df.withColumn(
        "_ing", two_sources(F.col("_payload"), F.col("_sheet"), F.col("ficha_ingredientes"))
    )
    df = df.withColumn(
        "_off",
        analysis_decision(F.col("off_labels"), F.col("off_analysis"), F.col("off_found")),
    )
    ing, source, off = F.col("_ing.evidence"), F.col("_ing.source"), F.col("_off")
    seals = F.split(F.coalesce(F.col("ficha_sellos"), F.lit("")), ",")
    registered = F.col("rnpa").isNotNull()
    declared = has_tag(F.col("off_labels"), "en:vegan")
    sealed = has_tag(seals, "vegan")
    number = F.concat(F.lit("(RNPA "), F.col("rnpa"), F.lit(")"))
    closed = registered | declared | sealed | resolved(ing) | resolved(off)
    df = name_heuristic(df, "nombre", "marca", "categoria", "_name", ~closed)
    name = F.col("_name")
    decision = (
        F.when(
            registered,
            certified(
                ing, SRC_REGISTRY,
                F.concat(F.lit("ANMAT lo registra con atributo vegano "), number),
                F.concat(F.lit("Registro oficial de ANMAT con atributo vegano "), number),
            ),
        )
        .when(
            declared,
            certified(
                ing, SRC_MAKER, F.lit("El fabricante lo declara vegano"),
                F.lit("Declarado vegano por el fabricante"),
            ),
        )
        .when(
            sealed,
            certified(
                ing, SRC_SEAL, F.lit("El supermercado lo certifica como vegano"),
                F.lit("Certificado como vegano en la ficha del supermercado"),
            ),
        )
        .when(
            resolved(ing) & resolved(off),
            agree_or_worse(ing, source, off, F.col("off_analysis")),
        )
        .when(resolved(ing), _answer(ing["estado"], source, ing["motivo"]))
        .when(resolved(off), off)
        .when(resolved(name), name)
        .otherwise(
            _answer(
                REVISAR, SRC_NONE,
                F.when(ing["n_ingredientes"] > 0, ing["motivo"]).otherwise(name["motivo"]),
            )
        )
    )
    return df.withColumn(out, settled(decision)).drop("_payload", "_sheet", "_ing", "_off", "_name")
