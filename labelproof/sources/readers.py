"""Landed files and payloads as product columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from labelproof.functions import text as T
from labelproof.operators.skew import first_rows
from labelproof.rules import relevance as R
from labelproof.rules import rows, words
from labelproof.rules.labels import REVIEW_COLUMNS, STATES

PAYLOAD = TY.StructType(
    [
        TY.StructField("code", TY.StringType()),
        TY.StructField("product_name", TY.StringType()),
        TY.StructField("brands", TY.StringType()),
        TY.StructField("ingredients_text", TY.StringType()),
        TY.StructField("ingredients_tags", TY.ArrayType(TY.StringType())),
        TY.StructField("ingredients_analysis_tags", TY.ArrayType(TY.StringType())),
        TY.StructField("labels_tags", TY.ArrayType(TY.StringType())),
        TY.StructField("categories_tags", TY.ArrayType(TY.StringType())),
        TY.StructField("image_front_small_url", TY.StringType()),
    ]
)

SHEET = TY.StructType(
    [
        TY.StructField(name, TY.StringType())
        for name in ("ean", "cadena", "ingredientes", "trazas", "sellos", "actualizado")
    ]
)

LISTING = (
    "struct<productName:string,brand:string,categories:array<string>,"
    "items:array<struct<ean:string,"
    "sellers:array<struct<commertialOffer:struct<Price:double>>>>>>"
)

SHEET_TABLE = "struct<table:struct<rows:array<struct<c:array<struct<v:string>>>>>>"


# --- price files --------------------------------------------------------------


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price file as text columns; malformed lines are skipped."""
    return spark.read.csv(path, header=True, mode="DROPMALFORMED")


def resolve_columns(names: list[str]) -> dict[str, str]:
    """File column of each known field: the first alias the header holds."""

    def plain(name: str) -> str:
        split = unicodedata.normalize("NFD", name)
        return "".join(c for c in split if unicodedata.category(c) != "Mn").lower().strip()

    present = {plain(name): name for name in names}
    resolved = {}
    for field, aliases in rows(R.COLUMN_ALIASES, 2):
        known = [present[a] for a in words(aliases) if a in present]
        if known:
            resolved[field] = known[0]
    return resolved


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Price file rows: ``ean, nombre, marca, categoria, precio_ref``."""
    found = resolve_columns(raw.columns)
    missing = [f for f in ("ean", "nombre") if f not in found]
    if missing:
        raise ValueError(f"no known column for {', '.join(missing)} in {raw.columns[:20]}")

    def column(field: str, clean) -> Column:
        if field not in found:
            kind = "double" if field == "precio_ref" else "string"
            return F.lit(None).cast(kind).alias(field)
        return clean(F.col(f"`{found[field]}`")).alias(field)

    return raw.select(
        column("ean", T.ean_normalize),
        column("nombre", T.blank_to_null),
        column("marca", T.blank_to_null),
        column("categoria", T.blank_to_null),
        column("precio_ref", T.price_parse),
    ).filter(F.col("ean").isNotNull() & F.col("nombre").isNotNull())


# --- dump and search hits -----------------------------------------------------


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated dump with a header, gzip files included.

    A gzip file is read by one task; its rows are dealt out right behind the read.
    """
    rows_ = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows_.repartition(parts) if path.endswith(".gz") else rows_


def tag_list(col: Column) -> Column:
    """Comma list as an array of trimmed, non-empty tags."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), T.collapse)
    return F.filter(parts, lambda t: t != "")


def country_rows(dump: DataFrame, country: str) -> DataFrame:
    """Dump rows whose country list contains the tag as a substring."""
    target = f"en:{country}".lower()
    return dump.filter(F.contains(F.lower("countries_tags"), F.lit(target)))


def dump_products(dump: DataFrame, country: str, limit: int | None = None) -> DataFrame:
    """Rows of one country with a code and a name, as payload columns."""
    chosen = country_rows(dump, country)
    if limit is not None:
        chosen = chosen.limit(limit)
    text = {
        "code": "code", "product_name": "product_name", "brands": "brands",
        "ingredients_text": "ingredients_text", "image_front_small_url": "image_small_url",
    }
    lists = ["ingredients_tags", "ingredients_analysis_tags", "labels_tags", "categories_tags"]
    return chosen.select(
        *[T.blank_to_null(F.col(src)).alias(name) for name, src in text.items()],
        *[tag_list(F.col(name)).alias(name) for name in lists],
    ).filter(F.col("code").isNotNull() & F.col("product_name").isNotNull())


def first_seen(hits: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """First hit per key over all passes; one without a name uses up its key.

    Every input task keeps the earliest hit of a key only, so a key with many
    hits needs no group in memory.
    """
    others = [c for c in hits.columns if c not in (key, *order)]
    kept = first_rows(hits, key, [F.asc_nulls_first(c) for c in (*order, *others)]).select(key, *order, *others)
    return kept.filter(T.blank_to_null(F.col(name)).isNotNull())


# --- registry sheet -----------------------------------------------------------


def registry_rows(pages: DataFrame, body: str, *keep: str) -> DataFrame:
    """Rows of wrapped sheet answers: ``razon_social, marca, producto, rnpa``."""
    inner = F.regexp_extract(F.col(body), r"(?s)setResponse\((.*)\);?\s*\z", 1)
    parsed = F.from_json(inner, SHEET_TABLE)
    cells = pages.select(*keep, F.explode(parsed["table"]["rows"]).alias("_row"))

    def cell(i: int) -> Column:
        return F.get(F.col("_row.c"), F.lit(i))["v"]

    def clean(i: int) -> Column:
        return F.nullif(F.trim(cell(i)), F.lit(""))

    header = T.norm_registry(cell(2)).isin(R.REGISTRY_HEADERS)
    filled = F.coalesce(cell(2), F.lit("")) != ""
    return cells.filter(filled & ~header).select(
        *keep,
        clean(0).alias("razon_social"),
        clean(1).alias("marca"),
        F.trim(cell(2)).alias("producto"),
        clean(3).alias("rnpa"),
    )


# --- shop listings and label sheets -------------------------------------------


def listing_items(listings: DataFrame, body: str, *keep: str) -> DataFrame:
    """One row per item of a listing JSON whose code is all digits."""
    parsed = listings.select(*keep, F.from_json(F.col(body), LISTING).alias("p"))
    category = F.get(F.col("p.categories"), F.size("p.categories") - 1)
    leaf = F.element_at(F.split(F.btrim(category, F.lit("/")), "/"), -1)
    items = parsed.select(
        *keep,
        F.col("p.productName").alias("nombre"),
        F.nullif(F.col("p.brand"), F.lit("")).alias("marca"),
        F.nullif(leaf, F.lit("")).alias("categoria"),
        F.posexplode("p.items").alias("posicion", "_item"),
    )
    ean = F.trim("_item.ean")
    offers = F.transform("_item.sellers", lambda s: s["commertialOffer"]["Price"])
    price = F.get(F.filter(offers, lambda p: p != 0), F.lit(0))
    return items.filter(ean.rlike(r"^\d+\z")).select(
        *keep, ean.alias("ean"), "nombre", "marca", "categoria", price.alias("precio"), "posicion"
    )


def quoted_text(cells: Column) -> Column:
    """Quoted items of a sheet field joined by commas, else its plain text."""
    raw = F.trim(F.array_join(cells, " "))
    items = F.filter(
        F.transform(F.regexp_extract_all(raw, F.lit("'([^']*)'"), 1), F.trim),
        lambda t: t != "",
    )
    text = F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(raw)
    return F.nullif(text, F.lit(""))


def seal_codes(cells: Column) -> Column:
    """Sorted distinct seal codes of a sheet field; unreadable cells are skipped."""
    kind = "array<struct<certification_type_code:string>>"
    # Literals of the source language that are none of JSON.
    def as_json(c: Column) -> Column:
        c = F.regexp_replace(c, r"\bNone\b", "null")
        return F.regexp_replace(F.regexp_replace(c, r"\bTrue\b", "true"), r"\bFalse\b", "false")

    lists = F.transform(
        cells, lambda c: F.from_json(as_json(c), kind, {"allowSingleQuotes": "true"})
    )
    codes = F.flatten(
        F.transform(
            F.filter(lists, lambda x: x.isNotNull()),
            lambda x: F.transform(x, lambda s: s["certification_type_code"]),
        )
    )
    filled = F.filter(codes, lambda c: F.coalesce(c, F.lit("")) != "")
    joined = F.array_join(F.array_sort(F.array_distinct(filled)), ",")
    return F.nullif(joined, F.lit(""))


def sheet_fields(products: DataFrame) -> DataFrame:
    """Sheet columns of raw products: ``ingredientes, trazas, sellos``."""
    return (
        products.withColumn("ingredientes", quoted_text(F.col("Ingredientes")))
        .withColumn("trazas", quoted_text(F.col("Trazas")))
        .withColumn("sellos", seal_codes(F.col("Sellos")))
    )


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot of label sheets, one JSON object per line; blank lines are skipped."""
    return spark.read.schema(SHEET).json(path).filter(F.col("ean").isNotNull())


# --- corrections and payloads -------------------------------------------------


def read_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Curated files of a folder, each read by the names in its own header.

    Columns are matched by name whatever their order; a leading mark is dropped;
    a file without a known header is an error. ``archivo`` is the file, ``linea``
    the row in it. Files are made by hand, so their number and size are small.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    first = F.regexp_extract(F.decode("content", "UTF-8"), r"\A\x{FEFF}?([^\r\n]*)", 1)
    by_header: dict[str, list[str]] = {}
    for row in files.select("path", first.alias("header")).orderBy("path").collect():
        by_header.setdefault(row["header"], []).append(row["path"])
    parts = []
    for header, paths in by_header.items():
        raw = spark.read.csv(paths, header=True, multiLine=True, escape='"')
        named = raw.toDF(*[c.lstrip("\ufeff").strip().strip('"') for c in raw.columns])
        if not {"ean", "estado_corregido"} <= set(named.columns):
            raise ValueError(f"no known header in {', '.join(paths)}: {header[:200]}")
        # A file of quoted text isn't split, so ids rise with its lines.
        parts.append(named.select(
            *[F.col(f"`{c}`") if c in named.columns else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS],
            F.col("_metadata.file_path").alias("archivo"),
            F.monotonically_increasing_id().alias("_id"),
        ))
    if not parts:
        text = ", ".join(f"{c} string" for c in REVIEW_COLUMNS)
        return spark.createDataFrame([], f"{text}, archivo string, linea long")
    rows_ = parts[0]
    for part in parts[1:]:
        rows_ = rows_.unionByName(part)
    line = F.row_number().over(Window.partitionBy("archivo").orderBy("_id")).cast("bigint")
    return rows_.withColumn("linea", line).drop("_id")


def check_corrections(raw: DataFrame) -> DataFrame:
    """Correction lines with ``clase``: aplicada, ignorada or invalida."""
    ean = F.trim(F.coalesce("ean", F.lit("")))
    state = F.lower(F.trim(F.coalesce("estado_corregido", F.lit(""))))
    kind = (
        F.when((ean == "") | (state == ""), "ignorada")
        .when(~state.isin(STATES), "invalida")
        .otherwise("aplicada")
    )
    return raw.select(
        "archivo",
        "linea",
        ean.alias("ean"),
        state.alias("estado"),
        F.nullif(F.trim("motivo_actual"), F.lit("")).alias("motivo"),
        F.coalesce(F.nullif(F.trim("revisor"), F.lit("")), F.lit("manual")).alias("revisor"),
        kind.alias("clase"),
    )


def load_corrections(raw: DataFrame) -> DataFrame:
    """Valid corrections, one per code: the last line of the last file wins."""
    valid = check_corrections(raw).filter("clase = 'aplicada'")
    last = valid.groupBy("ean").agg(
        F.max(F.struct("archivo", "linea", "estado", "motivo", "revisor")).alias("_l")
    )
    return last.select("ean", "_l.estado", "_l.motivo", "_l.revisor", "_l.archivo")


def parse_payload(cache: DataFrame, body: str = "payload") -> DataFrame:
    """Cache rows with the payload text as a struct; null stays null."""
    return cache.withColumn(body, F.from_json(F.col(body), PAYLOAD))
