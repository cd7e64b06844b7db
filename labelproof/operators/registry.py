"""Official registry: preparation and match without a shared key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.display import round_ratio
from labelproof.operators.skew import join_key_stats, reliable
from labelproof.rules import relevance as R
from labelproof.rules.labels import REGISTRY_OVERLAP


def prepare(
    registry: DataFrame,
    brand: str,
    product: str,
    start: str = R.FLAVOUR_START,
    end: str = R.FLAVOUR_END,
) -> DataFrame:
    """Registry rows with their brand key, product key and token sets."""
    return (
        registry.withColumn("marca_norm", T.norm_registry(F.col(brand)))
        .withColumn("producto_norm", T.norm_registry(F.col(product)))
        .withColumn("producto_tokens", T.token_set(F.col("producto_norm")))
        .withColumn("sabor_tokens", T.clause_tokens(F.col(product), start, end))
    )


def brand_parts(products: DataFrame, brand: str) -> DataFrame:
    """One row per product and non-empty brand of its comma list."""
    parts = products.select(
        "*", F.posexplode(F.split(F.col(brand), ",")).alias("_place", "_part")
    )
    return parts.withColumn("_brand", T.norm_registry(F.col("_part"))).filter(
        F.col("_brand") != ""
    )


def _joined(*cols: Column | str) -> Column:
    return F.concat_ws("\u0001", *cols)


# Rows of one (brand, token) that one task compares.
SALT_ROWS = 10_000


def _needed(size: Column, overlap: float) -> Column:
    return F.ceil(size * overlap - 1e-9).cast("int")


def token_sets(named: DataFrame, registry: DataFrame) -> DataFrame:
    """The kept token table: each distinct set of a brand once, its tokens from the rarest on.

    ``id, lado, _brand, _ordered`` (token and its count in the brand), and the payload of both
    sides: how many names share a set, and the first registry row with its flavour tokens.
    Side 0 are names, side 1 registry texts.
    """
    none = F.lit(None)
    names = named.groupBy("_brand", "_tokens").agg(F.count("*").alias("_weight"))
    entries = (
        registry.filter((F.col("marca_norm") != "") & (F.size("producto_tokens") > 0))
        .groupBy(
            F.col("marca_norm").alias("_brand"),
            F.col("producto_tokens").alias("_tokens"),
            F.col("sabor_tokens").alias("_flavour"),
        )
        .agg(F.min(F.struct("id", "rnpa")).alias("_first"))
    )
    kinds = entries.schema
    left = names.select(
        F.lit(0).alias("lado"), "_brand", "_tokens", "_weight",
        none.cast(kinds["_flavour"].dataType).alias("_flavour"), none.cast(kinds["_first"].dataType).alias("_first"),
    )
    right = entries.select(F.lit(1).alias("lado"), "_brand", "_tokens", F.lit(0).cast("long").alias("_weight"), "_flavour", "_first")
    sets = reliable(left.unionByName(right).withColumn("id", F.monotonically_increasing_id()))
    each = sets.select("id", "_brand", F.explode("_tokens").alias("_token"))
    each = each.withColumn("_pair", _joined("_brand", "_token"))
    rarity = reliable(each.groupBy("_pair").agg(F.count("*").alias("_weight"), F.count("*").alias("_count")))
    ranked = join_key_stats(each, rarity, "_pair", "_weight", F.col("id").cast("string"))
    ordered = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_count", "_token"))).alias("_ordered"))
    return reliable(sets.drop("_tokens").join(ordered, "id"))


def candidates(sets: DataFrame, overlap: float = REGISTRY_OVERLAP) -> DataFrame:
    """Pairs of a name and a registry set that can reach the overlap, each once: ``_l, _r``.

    Two sets are compared at the first token, from the rarest on, that both have. It must stand
    among the first tokens of the smaller set, and in both sets enough tokens must follow it. A
    token of a brand meets only sets of its own length bucket or a longer one, and one that many
    sets hold is dealt out over salts that its count names on both sides.
    """
    named = sets.withColumn("tokens", F.transform("_ordered", lambda t: t["_token"]))
    named = named.withColumn("_set", F.struct("id", "_brand", "tokens", "_weight", "_flavour", "_first"))
    placed = named.select(
        "lado", "_brand", "_set", F.size("_ordered").alias("_size"), F.posexplode("_ordered").alias("_at", "_t"),
    ).select("lado", "_brand", "_set", "_size", "_at", F.col("_t._token").alias("_token"), F.ceil(F.col("_t._count") / SALT_ROWS).cast("int").alias("_salts"))
    bucket = F.floor(F.log2("_size")).cast("int")
    largest = sets.agg(F.max(F.floor(F.log2(F.size("_ordered"))))).first()[0] or 0
    need = _needed(F.col("_size"), overlap)

    def small(side: int) -> DataFrame:
        rows = placed.filter((F.col("lado") == side) & (F.col("_at") <= F.col("_size") - need))
        rows = rows.withColumn("_bucket", F.explode(F.sequence(bucket, F.lit(largest))))
        return rows.select(
            "_brand", "_token", "_bucket", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"),
            F.col("_set").alias("_s"), F.col("_size").alias("_n"), need.alias("_need"),
        )

    def large(side: int) -> DataFrame:
        return placed.filter(F.col("lado") == side).select(
            "_brand", "_token", bucket.alias("_bucket"), F.pmod(F.col("_set.id"), F.col("_salts")).cast("int").alias("_salt"),
            F.col("_set").alias("_b"), F.col("_size").alias("_m"), F.col("_at").alias("_place"),
        )

    def paired(side: int) -> DataFrame:
        sizes = F.col("_n") <= F.col("_m") if side == 0 else F.col("_n") < F.col("_m")
        enough = F.col("_place") <= F.col("_m") - F.col("_need")
        met = small(side).join(large(1 - side), ["_brand", "_token", "_bucket", "_salt"]).filter(sizes & enough)
        first = F.get(F.filter("_s.tokens", lambda t: F.array_contains("_b.tokens", t)), F.lit(0))
        met = met.filter(F.col("_token") == first)
        name, entry = ("_s", "_b") if side == 0 else ("_b", "_s")
        return met.select(F.col(name).alias("_l"), F.col(entry).alias("_r"))

    return paired(0).unionByName(paired(1))


def match(
    products: DataFrame,
    registry: DataFrame,
    overlap: float = REGISTRY_OVERLAP,
) -> DataFrame:
    """Best registry row per product: ``ean, id, rnpa, score``.

    ``products`` has ``ean, nombre, marca``; ``registry`` is prepared and has
    ``id, rnpa``. The brands must agree; the score is the share of the smaller
    token set that both have, and at least one shared token must stand outside
    the flavour clause. Ties go to the earlier brand, then to the lower id.

    Equal names and equal registry texts of a brand are compared once.
    """
    named = brand_parts(products.select("ean", "nombre", "marca"), "marca").withColumn(
        "_tokens", T.token_set(F.col("nombre"))
    )
    named = named.filter(F.size("_tokens") > 0).select("ean", "_place", "_brand", "_tokens")
    named = reliable(named.withColumn("_name", _joined("_brand", F.array_join("_tokens", " "))))
    pairs = candidates(token_sets(named, registry), overlap)
    shared = F.array_intersect("_l.tokens", "_r.tokens")
    smaller = F.least(F.size("_l.tokens"), F.size("_r.tokens"))
    scored = pairs.select(
        "_l", F.col("_r._first").alias("_first"), (F.size(shared) / smaller).alias("_score"),
        round_ratio(F.size(shared), smaller, 2).alias("_rounded"), F.array_except(shared, F.col("_r._flavour")).alias("_outside"),
    ).filter((F.size("_outside") > 0) & (F.col("_score") >= overlap))
    name = _joined("_l._brand", F.array_join(F.array_sort("_l.tokens"), " ")).alias("_name")
    best = scored.groupBy(name, F.col("_l._weight").alias("_weight")).agg(
        F.max(F.struct("_score", (-F.col("_first.id")).alias("_order"), "_first", "_rounded")).alias("_best")
    )
    # Equal names share one result; a very common name is joined by broadcast.
    found = join_key_stats(named, reliable(best), "_name", "_weight", F.col("ean"))
    chosen = found.filter(F.col("_best").isNotNull()).groupBy("ean").agg(
        F.max(
            F.struct(
                F.col("_best._score").alias("score"),
                (-F.col("_place")).alias("place"),
                F.col("_best._order").alias("order"),
                F.col("_best._first").alias("first"),
                F.col("_best._rounded").alias("rounded"),
            )
        ).alias("_top")
    )
    return chosen.select(
        "ean",
        F.col("_top.first.id").alias("id"),
        F.col("_top.first.rnpa").alias("rnpa"),
        F.col("_top.rounded").alias("score"),
    )
