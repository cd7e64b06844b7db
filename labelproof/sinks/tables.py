"""Keyed tables, snapshots, exports and the search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.operators.skew import dense_positions, join_key_stats
from labelproof.rules.labels import (
    EXPORT_SOURCES, IMAGE_PREFIX, REVIEW_COLUMNS, STATES,
)

SNAPSHOT_COLUMNS = ["ean", "cadena", "ingredientes", "trazas", "sellos", "actualizado"]


def upsert(current: DataFrame | None, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Table after an upsert: the last write per key wins."""
    both = incoming if current is None else current.unionByName(incoming)
    others = [c for c in both.columns if c not in (*key, *order)]
    return latest(both, key, [*order, *others]).select(*key, *order, *others)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key in the given order of columns.

    The filter on the row number lets every input task cut a key to one row
    before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def merge_newer(existing: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """Table after a merge: incoming wins only when its time is later.

    Keys are unique on the existing side; several incoming lines of a key count
    by their newest. ``accion`` says what happened to each row.
    """
    values = [c for c in existing.columns if c != key]
    others = [c for c in values if c != stamp]
    newest = latest(incoming, [key], [stamp, *others]).select(key, F.struct(stamp, *others).alias("_in"))
    old = existing.select(key, F.struct(*values).alias("_old"))
    joined = old.join(newest, key, "full")
    take = F.col("_in").isNotNull() & (
        F.col("_old").isNull() | (F.col(f"_old.{stamp}") < F.col(f"_in.{stamp}"))
    )
    action = (
        F.when(take & F.col("_old").isNull(), "nueva")
        .when(take, "actualizada")
        .otherwise("igual")
    )
    return joined.select(
        key,
        *[F.when(take, F.col(f"_in.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values],
        action.alias("accion"),
    )


def merge_counts(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """Counts of a merge: ``leidas, nuevas, actualizadas``."""
    done = merged.agg(
        F.count_if(F.col("accion") == "nueva").alias("nuevas"),
        F.count_if(F.col("accion") == "actualizada").alias("actualizadas"),
    )
    read = incoming.agg(F.count("*").alias("leidas"))
    return done.select(read.scalar().alias("leidas"), "nuevas", "actualizadas")


def snapshot(sheets: DataFrame) -> DataFrame:
    """Snapshot rows: sorted by code, empty fields as null so they are not written."""
    return sheets.select(
        *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in SNAPSHOT_COLUMNS]
    ).orderBy("ean")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Write rows as one JSON object per line, null fields left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def export_products(products: DataFrame) -> DataFrame:
    """Public product rows sorted by code; empty values become null."""

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    image = F.when(~F.contains("imagen_url", F.lit("/invalid/")), filled("imagen_url"))
    return products.select(
        "ean",
        T.product_route(F.col("ean"), F.col("nombre")).alias("slug"),
        "nombre",
        "estado",
        F.col("fuente_decision").alias("fuente"),
        filled("marca").alias("marca"),
        filled("categoria").alias("categoria"),
        F.bround("confianza", 3).alias("confianza"),
        filled("motivo").alias("motivo"),
        filled("ingredients_text").alias("ingredientes"),
        image.alias("imagen"),
        F.when(F.size("cadenas") > 0, F.col("cadenas")).alias("cadenas"),
    ).orderBy("ean")


def export_summary(exported: DataFrame) -> DataFrame:
    """Summary lines: ``seccion, nombre, slug, n, orden``.

    Verdicts come in their fixed order with zeros kept, sources by size,
    categories by name. One scan counts the three kinds and the totals.
    """
    kinds = F.array(
        F.struct(F.lit("estado").alias("seccion"), F.col("estado").alias("nombre")),
        F.struct(F.lit("fuente").alias("seccion"), F.col("fuente").alias("nombre")),
        F.struct(F.lit("categoria").alias("seccion"), F.col("categoria").alias("nombre")),
        F.struct(F.lit("total").alias("seccion"), F.lit("total").alias("nombre")),
        F.struct(
            F.lit("total").alias("seccion"),
            F.when(F.col("fuente").isin(EXPORT_SOURCES), "con_evidencia").alias("nombre"),
        ),
        F.struct(
            F.lit("total").alias("seccion"),
            F.when(F.col("ingredientes").isNotNull(), "con_ingredientes").alias("nombre"),
        ),
        F.struct(
            F.lit("total").alias("seccion"),
            F.when(F.col("cadenas").isNotNull(), "confirmados").alias("nombre"),
        ),
    )
    counted = (
        exported.select(F.explode(kinds).alias("_k"))
        .filter(F.col("_k.nombre").isNotNull())
        .groupBy("_k.seccion", "_k.nombre")
        .agg(F.count("*").alias("n"))
    )
    spark = exported.sparkSession
    fixed = spark.createDataFrame(
        [("estado", s) for s in STATES]
        + [("total", s) for s in ("total", "con_evidencia", "con_ingredientes", "confirmados")],
        "seccion string, nombre string",
    )
    known = fixed.join(counted, ["seccion", "nombre"], "left").select(
        "seccion", "nombre", F.coalesce("n", F.lit(0)).alias("n")
    )
    rest = counted.filter(F.col("seccion").isin("fuente", "categoria"))
    slug = F.when(F.col("seccion") == "categoria", T.slugify(F.col("nombre")))
    return known.unionByName(rest).select("seccion", "nombre", slug.alias("slug"), "n")


# A mask of chains is one signed 64-bit number.
MOST_CHAINS = 63


def dictionary(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Ids of distinct values in order of first appearance: ``valor, idx, n``."""
    first = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("valor"))
        .agg(F.min(key).alias("_first"), F.count("*").alias("n"))
    )
    placed = dense_positions(first, [F.col("_first"), F.col("valor")], "idx")
    return placed.select("valor", "idx", "n")


def chain_dictionary(exported: DataFrame) -> DataFrame:
    """Bit of each chain in order of first appearance. Chains are few by nature."""
    listed = exported.select("ean", F.posexplode("cadenas").alias("_i", "cadena"))
    first = listed.groupBy("cadena").agg(F.min(F.struct("ean", "_i")).alias("_first"))
    return dense_positions(first, [F.col("_first"), F.col("cadena")], "bit").select("cadena", "bit")


def index_rows(exported: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Compact search index rows and their dictionaries.

    Ids are −1 for a missing value; the chains of a row are one bit mask, and
    more chains than it has bits are an error.
    """
    dicts = {
        "marca": dictionary(exported, "marca", "ean"),
        "categoria": dictionary(exported, "categoria", "ean"),
        "fuente": dictionary(exported, "fuente", "ean"),
        "cadena": chain_dictionary(exported),
    }
    df = exported
    for name in ("marca", "categoria", "fuente"):
        ids = dicts[name].select(
            F.col("valor").alias(name), F.col("idx").alias(f"{name}_idx"), "n"
        )
        df = join_key_stats(df, ids, name, "n", F.col("ean")).withColumn(
            f"{name}_idx", F.coalesce(f"{name}_idx", F.lit(-1)).cast("bigint")
        )
    bits = dicts["cadena"].agg(
        F.when(F.count("*") > MOST_CHAINS, F.raise_error(F.lit(f"more than {MOST_CHAINS} chains")))
        .otherwise(F.map_from_entries(F.collect_list(F.struct("cadena", F.col("bit").cast("int")))))
        .alias("m")
    )
    masks = df.withColumn("_bits", bits.scalar())
    one = F.lit(1).cast("bigint")
    mask = F.aggregate(
        F.coalesce("cadenas", F.array().cast("array<string>")),
        F.lit(0).cast("bigint"),
        lambda a, c: a.bitwiseOR(
            F.call_function("shiftleft", one, F.try_element_at(F.col("_bits"), c))
        ),
    )
    state = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("estado")) - 1
    image = F.coalesce("imagen", F.lit(""))
    cut = F.when(
        F.startswith(image, F.lit(IMAGE_PREFIX)), F.substr(image, F.lit(len(IMAGE_PREFIX) + 1))
    ).otherwise(image)
    rows = masks.select(
        "ean", "slug", "nombre", "marca_idx", "categoria_idx",
        state.cast("bigint").alias("estado_idx"), "fuente_idx", mask.alias("bits"),
        F.when(F.col("ingredientes").isNotNull(), 1).otherwise(0).cast("bigint").alias("ingr"),
        F.coalesce("motivo", F.lit("")).alias("motivo"), cut.alias("imagen"),
    )
    return rows, dicts


def decode_index(rows: DataFrame, dicts: dict[str, DataFrame]) -> DataFrame:
    """Index rows back as readable columns."""
    df = rows
    for name in ("marca", "categoria", "fuente"):
        known = F.when(F.col(f"{name}_idx") >= 0, F.col(f"{name}_idx").cast("string"))
        values = dicts[name].select(
            F.col("idx").cast("string").alias("_id"), F.col("valor").alias(name), "n"
        )
        df = join_key_stats(df.withColumn("_id", known), values, "_id", "n", F.col("ean"))
    bits = dicts["cadena"].agg(
        F.array_sort(F.collect_list(F.struct(F.col("bit").cast("int").alias("bit"), "cadena"))).alias("m")
    )
    df = df.withColumn("_bits", bits.scalar())
    on = F.filter(
        F.coalesce(F.col("_bits"), F.array().cast("array<struct<bit:int,cadena:string>>")),
        lambda b: F.call_function("shiftright", F.col("bits"), b["bit"]).bitwiseAND(F.lit(1)) == 1,
    )
    state = F.get(F.array(*[F.lit(s) for s in STATES]), F.col("estado_idx").cast("int"))
    image = F.when(F.col("imagen") != "", F.concat(F.lit(IMAGE_PREFIX), F.col("imagen")))
    return df.select(
        "ean", "slug", "nombre", "marca", "categoria", state.alias("estado"), "fuente",
        F.transform(on, lambda b: b["cadena"]).alias("cadenas"),
        (F.col("ingr") == 1).alias("con_ingredientes"),
        F.nullif(F.col("motivo"), F.lit("")).alias("motivo"), image.alias("imagen"),
    )


def review_rows(queue: DataFrame) -> DataFrame:
    """Review file rows: fixed columns, ingredients cut, decisions left blank."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    values = [
        F.col("ean"), F.col("nombre"), filled("marca"), filled("categoria"), F.col("estado"),
        filled("motivo"), F.substring(filled("ingredients_text"), 1, 300), F.lit(""), F.lit(""),
    ]
    return queue.select(*[v.alias(n) for v, n in zip(values, REVIEW_COLUMNS, strict=True)])


def write_review_csv(rows: DataFrame, path: str) -> None:
    """Write review rows with a header and the mark spreadsheets look for.

    The mark is the first character of the header of each part.
    """
    first = REVIEW_COLUMNS[0]
    marked = rows.withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")
