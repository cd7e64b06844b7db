"""Which products are judged, and with which features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.operators import brands as B
from labelproof.operators import categories as C
from labelproof.operators.quality import exclusion_reason
from labelproof.rules import rows
from labelproof.rules.labels import CHAIN_LABELS, SHEET_CHAINS, WEAK_SOURCES

CHAIN_ORDER = [chain for chain, _ in rows(CHAIN_LABELS, 2)]


def chain_rank(chain: Column) -> Column:
    """Place of a chain in the scan order; unknown chains come last."""
    rank = F.lit(len(CHAIN_ORDER))
    for place, name in reversed(list(enumerate(CHAIN_ORDER))):
        rank = F.when(chain == name, place).otherwise(rank)
    return rank


def with_payload(catalog: DataFrame, cache: DataFrame) -> DataFrame:
    """Catalog rows with the payload of a found cache entry, else null."""
    found = cache.filter("found").select("ean", "payload")
    return catalog.join(found, "ean", "left")


def shelf_only(catalog: DataFrame, shelf: DataFrame, sheets: DataFrame) -> DataFrame:
    """Shelf rows whose sheet has ingredients or the exact vegan seal.

    The row comes from the chain that gave the sheet, and only for codes the
    catalog does not hold. Filters run before the joins.
    """
    seals = F.split(F.coalesce(F.col("sellos"), F.lit("")), ",")
    backed = sheets.filter(
        (F.coalesce(F.col("ingredientes"), F.lit("")) != "") | F.array_contains(seals, "vegan")
    ).select("ean", "cadena")
    named = shelf.filter(F.trim(F.col("nombre")) != "")
    return (
        named.join(backed, ["ean", "cadena"])
        .join(catalog.select("ean"), "ean", "left_anti")
        .select("ean", "nombre", "marca", F.col("precio").alias("precio_ref"))
    )


def universe(
    catalog: DataFrame, cache: DataFrame, shelf: DataFrame, sheets: DataFrame
) -> DataFrame:
    """Catalog rows with payloads, then the shelf rows their sheets back."""
    listed = with_payload(catalog, cache).select(
        "ean", "nombre", "marca", "precio_ref", "payload"
    )
    return listed.unionByName(
        shelf_only(catalog, shelf, sheets), allowMissingColumns=True
    )


def shelf_features(shelf: DataFrame) -> DataFrame:
    """Per code the first non-blank brand and the first shelf with a category."""
    rank = chain_rank(F.col("cadena"))
    brand = F.trim(F.col("marca"))
    filled = F.coalesce(brand, F.lit("")) != ""
    mapped = C.from_shelf(F.col("categoria")).isNotNull()
    return shelf.groupBy("ean").agg(
        F.min(F.when(filled, F.struct(rank.alias("r"), brand.alias("v"))))["v"].alias(
            "marca_gondola"
        ),
        F.min(F.when(mapped, F.struct(rank.alias("r"), F.col("categoria").alias("v"))))[
            "v"
        ].alias("gondola"),
    )


def features(
    candidates: DataFrame,
    catalog: DataFrame,
    shelf: DataFrame,
    sheets: DataFrame,
) -> DataFrame:
    """Candidates with unified brand, category and sheet columns.

    ``payload`` is a parsed struct. The joins on the code use one partitioning.
    """
    df = candidates.join(shelf_features(shelf), "ean", "left").join(
        sheets.select(
            "ean",
            F.col("ingredientes").alias("ficha_ingredientes"),
            F.col("sellos").alias("ficha_sellos"),
        ),
        "ean",
        "left",
    )
    df = df.withColumn("_filled", B.fill_brand(F.col("marca"), F.col("marca_gondola")))
    mapping = B.brand_map(
        B.spelling_votes(catalog, "marca"), B.spelling_votes(shelf, "marca")
    )
    df = B.apply_map(df, "_filled", mapping, F.col("ean"), "marca").drop("_filled")
    category = C.final(F.col("payload.categories_tags"), F.col("nombre"), F.col("gondola"))
    return df.withColumn("categoria", category).drop("marca_gondola", "gondola")


def harvest_queue(
    shelf: DataFrame,
    sheets: DataFrame,
    products: DataFrame,
    chains: list[str] | None = None,
    limit: int | None = None,
    **lists,
) -> DataFrame:
    """Codes whose sheet is still to be asked for, most useful first.

    The least chain, name and priority of a code are taken one by one, so they
    need not come from one row.
    """
    chains = SHEET_CHAINS if chains is None else chains
    known = products.select(
        "ean",
        F.lit(True).alias("_known"),
        (
            (F.coalesce(F.col("ingredients_text"), F.lit("")) == "")
            | F.col("fuente_decision").isin(WEAK_SOURCES)
        ).alias("_weak"),
    )
    # One row per code first: the priority depends on the code alone.
    listed = (
        shelf.filter(F.col("cadena").isin(chains))
        .groupBy("ean")
        .agg(F.min("cadena").alias("cadena"), F.min("nombre").alias("nombre"))
    )
    waiting = listed.join(sheets.select("ean"), "ean", "left_anti")
    priority = (
        F.when(F.substring("ean", 1, 1) == "2", 3)
        .when(F.col("_known").isNull(), 1)
        .when(F.col("_weak"), 0)
        .otherwise(2)
    )
    queue = (
        waiting.filter(exclusion_reason(F.col("nombre"), F.col("ean"), **lists).isNull())
        .join(known, "ean", "left")
        .select("ean", "cadena", "nombre", priority.alias("prioridad"))
        .orderBy("prioridad", "ean")
    )
    return queue if limit is None else queue.limit(limit)
