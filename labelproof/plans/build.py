"""The whole build: from the loaded tables to the judged product table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelproof.operators import candidates, coverage, model, quality, reconcile, registry, verdict
from labelproof.operators.skew import reliable
from labelproof.rules.labels import SRC_HUMAN
from labelproof.sinks import tables
from labelproof.sources.readers import parse_payload


def judged_candidates(
    catalog: DataFrame,
    cache: DataFrame,
    shelf: DataFrame,
    sheets: DataFrame,
    registered: DataFrame,
) -> DataFrame:
    """Relevant candidates with their features and decision struct.

    ``catalog``: ean, nombre, marca, precio_ref. ``cache``: ean, found, payload
    (JSON text). ``shelf``: one row per ean and cadena. ``sheets``: one row per
    ean. ``registered``: id, marca, producto, rnpa. Irrelevant rows leave before
    any evidence is read.
    """
    listed = candidates.universe(catalog, cache, shelf, sheets)
    kept = listed.filter(
        quality.exclusion_reason(F.col("nombre"), F.col("ean")).isNull()
    )
    # Read by the registry match and by the decision.
    df = reliable(candidates.features(parse_payload(kept), catalog, shelf, sheets))
    prepared = registry.prepare(registered, "marca", "producto")
    hits = registry.match(df.select("ean", "nombre", "marca"), prepared)
    # Few rows; written so that the match is not planned again by every step below.
    df = df.join(reliable(hits.select("ean", "rnpa")), "ean", "left")
    df = df.select(
        "*",
        F.coalesce(F.col("payload").isNotNull(), F.lit(False)).alias("off_found"),
        F.col("payload.ingredients_text").alias("off_text"),
        F.col("payload.ingredients_tags").alias("off_tags"),
        F.col("payload.ingredients_analysis_tags").alias("off_analysis"),
        F.col("payload.labels_tags").alias("off_labels"),
    )
    return verdict.decide(df)


def product_rows(judged: DataFrame) -> DataFrame:
    """Judged candidates in the columns of the product table."""
    text = F.coalesce(F.nullif("off_text", F.lit("")), "ficha_ingredientes")
    return judged.select(
        "ean",
        "nombre",
        "marca",
        "categoria",
        F.col("decision.estado").alias("estado"),
        F.col("decision.fuente").alias("fuente_decision"),
        F.lit(None).cast("double").alias("confianza"),
        text.alias("ingredients_text"),
        F.col("payload.image_front_small_url").alias("imagen_url"),
        "precio_ref",
        F.col("decision.motivo").alias("motivo"),
        F.col("payload.categories_tags").alias("categories_tags"),
    )


def build_products(
    catalog: DataFrame,
    cache: DataFrame,
    shelf: DataFrame,
    sheets: DataFrame,
    registered: DataFrame,
    corrections: DataFrame,
    strict_reference: bool = False,
    judged: DataFrame | None = None,
) -> DataFrame:
    """Judged products after duplicates, corrections, chains and purges.

    A row that a person corrected is kept even without any other signal;
    ``strict_reference`` purges it like every other row. ``judged`` takes
    candidates that are judged already.
    """
    if judged is None:
        judged = judged_candidates(catalog, cache, shelf, sheets, registered)
    df = product_rows(judged)
    # The evidence is read by the duplicate groups and by their members.
    df = reliable(df)
    df = reconcile.reconcile_duplicates(df)
    df = reconcile.apply_corrections(df, corrections)
    df = reconcile.confirm_chains(df, shelf)
    phantom = quality.is_phantom(
        F.col("categories_tags"), F.col("ingredients_text"), F.col("cadenas"),
        F.col("fuente_decision"),
    )
    if not strict_reference:
        phantom = phantom & (F.col("fuente_decision") != SRC_HUMAN)
    return quality.drop_excluded(df.filter(~phantom), "ean").drop("categories_tags")


class Refreshed(NamedTuple):
    """What a refresh leaves: the table, the model's report, coverage, export and summary."""

    products: DataFrame
    metrics: DataFrame
    coverage: DataFrame
    exported: DataFrame
    summary: DataFrame


def refresh(
    catalog: DataFrame,
    cache: DataFrame,
    shelf: DataFrame,
    sheets: DataFrame,
    registered: DataFrame,
    corrections: DataFrame,
) -> Refreshed:
    """Build the products, train and measure a model on the evidenced rows, settle unresolved
    ones with it, and report.

    The model learns from three quarters of each class and is measured on the rest.
    """
    judged = reliable(judged_candidates(catalog, cache, shelf, sheets, registered))
    products = reliable(
        build_products(catalog, cache, shelf, sheets, registered, corrections, judged=judged)
    )
    parted = reliable(model.split(model.training_set(products), "estado", "ean"))
    fitted = model.fit(parted.filter("entrena").drop("entrena"))
    held = model.predict(fitted, parted.filter("NOT entrena"))
    # The report counts the likeliest class; thresholds only decide what is applied.
    top = F.array_position("probas", F.array_max("probas")).cast("int") - 1
    held = held.select("estado", F.get("clases", top).alias("predicho"))
    settled = reliable(model.apply(fitted, products))
    exported = tables.export_products(settled)
    return Refreshed(
        settled, model.metrics(held), coverage.report(judged), exported, tables.export_summary(exported)
    )
