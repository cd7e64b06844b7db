"""Source and keyed-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelproof.bindings.views import VIEWS, sql, view
from labelproof.operators import coverage, quality
from labelproof.operators.skew import shared_folder
from labelproof.queries.base import query
from labelproof.queries.text_queries import _EAN_CHECK
from labelproof.sinks import tables as S
from labelproof.sinks.keyed import KeyedTable
from labelproof.sources import readers as R


def price_file(spark, d):
    """The price lines under the column names of a price file."""
    rows = view(spark, d, "v_codes")
    return rows.select(
        F.col("codigo").alias("producto_id"),
        F.concat(F.lit(" "), F.col("food"), F.lit("  ")).alias("Descripción"),
        F.col("marca_texto").alias("Productos_Marca"),
        F.col("precio_texto").alias("precio_lista"),
    )


_PRICES = f"""SELECT ean, nombre, marca, precio_ref FROM (SELECT {_EAN_CHECK} AS ean, food AS nombre,
  CASE WHEN trim(marca_texto) = '' THEN NULL ELSE 'Marca ' || adj END AS marca,
  try_cast(replace(precio_texto, ',', '.') AS DOUBLE) AS precio_ref FROM v_codes)
  WHERE ean IS NOT NULL"""


@query("src_csv_aliases", _PRICES)
def src_csv_aliases(spark, d):
    return R.normalize_prices(price_file(spark, d)).drop("categoria")


@query(
    "lowest_price",
    f"""SELECT ean, precio_ref, nombre FROM (SELECT ean, precio_ref, nombre, row_number() OVER (
    PARTITION BY ean ORDER BY precio_ref ASC NULLS LAST, nombre) AS i FROM ({_PRICES})) WHERE i = 1""",
)
def lowest_price(spark, d):
    rows = R.normalize_prices(price_file(spark, d)).select("ean", "precio_ref", "nombre")
    return coverage.lowest_price(rows, "ean", "precio_ref", ["nombre"])


VIEWS["v_dump"] = """
SELECT o, lpad(cast(o AS varchar(20)), 13, '0') AS code,
  CASE WHEN o % 8 = 5 THEN '  ' ELSE ' Lote   ' || cast(o AS varchar(20)) END AS product_name,
  'en:' || LISTAGG[tipo|,en:|k] AS countries_tags, LISTAGG[tag|, ,|k] AS ingredients_tags
FROM (SELECT o, k, tag, lower(p_type) AS tipo FROM v_line) x GROUP BY o
"""


@query(
    "src_tag_filter",
    """SELECT code, 'Lote ' || cast(o AS VARCHAR) AS product_name,
      replace(ingredients_tags, ', ,', ',') AS ingredients_tags FROM v_dump
    WHERE o % 8 <> 5 AND countries_tags LIKE '%en:promo%'""",
)
def src_tag_filter(spark, d):
    dump = view(spark, d, "v_dump")
    missing = ["brands", "ingredients_text", "image_small_url", "ingredients_analysis_tags",
               "labels_tags", "categories_tags"]
    dump = dump.select("*", *[F.lit(None).cast("string").alias(c) for c in missing])
    rows = R.dump_products(dump, "promo")
    return rows.select(
        "code", "product_name", F.array_join("ingredients_tags", ",").alias("ingredients_tags")
    )


@query(
    "dedup_first_seen",
    """WITH u AS (SELECT user_id, 1 AS pasada, event_id AS pos, event_type FROM events
      UNION ALL SELECT user_id, 2, -event_id, event_type FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pasada, pos) AS i FROM u)
    SELECT user_id, pos, event_type AS nombre FROM r WHERE i = 1 AND event_type <> 'view'""",
)
def dedup_first_seen(spark, d):
    hits = sql(
        spark, d,
        "SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS nombre"
        " FROM events",
    )
    up = hits.select("user_id", F.lit(1).alias("pasada"), F.col("event_id").alias("pos"), "nombre")
    down = hits.select("user_id", F.lit(2).alias("pasada"), (-F.col("event_id")).alias("pos"), "nombre")
    seen = R.first_seen(up.unionByName(down), "user_id", ["pasada", "pos"], "nombre")
    return seen.select("user_id", "pos", "nombre")


VIEWS["v_sheet_page"] = """
SELECT o, '/*O_o*/ x.setResponse({"table":{"rows":[{"c":[null,null,{"v":"Identificación del Producto"}]},'
  || LISTAGG[fila|,|k] || ']}});' AS cuerpo
FROM (SELECT o, k, '{"c":[{"v":" ' || p_type || ' "},' || CASE WHEN noun = 'ring' THEN 'null'
    ELSE '{"v":"' || adj || '"}' END || ',' || CASE WHEN noun = 'bolt' THEN '{"v":""}' ELSE
    '{"v":"' || food || '"}' END || CASE WHEN noun = 'gear' THEN '' ELSE ',{"v":"' || ean || '"}' END
    || ']}' AS fila FROM v_line) x GROUP BY o
"""


@query(
    "src_wrapped_json",
    """SELECT o, p_type AS razon_social, CASE WHEN noun = 'ring' THEN NULL ELSE adj END AS marca,
      food AS producto, CASE WHEN noun = 'gear' THEN NULL ELSE ean END AS rnpa
    FROM v_line WHERE noun <> 'bolt'""",
)
def src_wrapped_json(spark, d):
    return R.registry_rows(view(spark, d, "v_sheet_page"), "cuerpo", "o")


@query(
    "src_json_payload",
    """SELECT ean, off_txt AS texto, off_tags AS tags, off_analysis AS analisis, off_labels AS sellos,
      nullif(off_image, '') AS imagen FROM v_payload WHERE found""",
)
def src_json_payload(spark, d):
    found = R.parse_payload(view(spark, d, "v_cache").filter("found"))
    return found.select(
        "ean",
        F.col("payload.ingredients_text").alias("texto"),
        F.array_join("payload.ingredients_tags", ",").alias("tags"),
        F.array_join("payload.ingredients_analysis_tags", ",").alias("analisis"),
        F.array_join("payload.labels_tags", ",").alias("sellos"),
        F.col("payload.image_front_small_url").alias("imagen"),
    )


VIEWS["v_listing"] = """
SELECT o, '{"productName":"Lote ' || cast(o AS varchar(20)) || '","brand":"'
  || CASE WHEN o % 3 = 0 THEN '' ELSE 'Marca' END || '","categories":["/Almacén/","/Almacén/Rubro '
  || cast(o % 7 AS varchar(20)) || '/"],"items":[' || LISTAGG[item|,|k] || ']}' AS cuerpo
FROM (SELECT o, k, '{"ean":" ' || CASE WHEN noun = 'bolt' THEN 'sin código' ELSE ean END
    || ' ","sellers":[{"commertialOffer":{"Price":' || CASE WHEN l_linenumber = 2 THEN '0' ELSE
    cast(l_suppkey + 1 AS varchar(20)) || '.5' END || '}},{"commertialOffer":{"Price":7.25}}]}'
    AS item FROM v_line) x GROUP BY o
"""


@query(
    "src_explode_items",
    """SELECT o, ean, 'Lote ' || o AS nombre, CASE WHEN o % 3 = 0 THEN NULL ELSE 'Marca' END AS marca,
      'Rubro ' || (o % 7) AS categoria, CASE WHEN l_linenumber = 2 THEN 7.25 ELSE l_suppkey + 1.5 END::DOUBLE
      AS precio FROM v_line WHERE noun <> 'bolt'""",
)
def src_explode_items(spark, d):
    return R.listing_items(view(spark, d, "v_listing"), "cuerpo", "o").drop("posicion")


VIEWS["v_sheet_raw"] = """
SELECT o, CASE WHEN o % 9 = 4 THEN LISTAGG[food| + |k] ELSE LISTAGG[citado|, |k] END AS celda,
  CASE WHEN o % 9 = 4 THEN 'no es una lista' ELSE '[' || LISTAGG[sello|, |k] || ']' END AS sellos
FROM (SELECT o, k, food, '''' || food || '''' AS citado,
    '{''certification_type_code'': ' || CASE WHEN noun = 'bolt' THEN 'None' ELSE '''' || noun || '''' END
    || ', ''ok'': True}' AS sello FROM v_line) x GROUP BY o
"""


@query(
    "src_quoted_list",
    """SELECT o, CASE WHEN o % 9 = 4 THEN string_agg(food, ' + ' ORDER BY k)
    ELSE string_agg(food, ', ' ORDER BY k) END AS ingredientes FROM v_line GROUP BY o""",
)
def src_quoted_list(spark, d):
    rows = view(spark, d, "v_sheet_raw")
    return rows.select("o", R.quoted_text(F.array("celda")).alias("ingredientes"))


@query(
    "src_seal_codes",
    """SELECT o, string_agg(DISTINCT noun, ',' ORDER BY noun) FILTER (WHERE noun <> 'bolt' AND o % 9 <> 4)
    AS sellos FROM v_line GROUP BY o""",
)
def src_seal_codes(spark, d):
    rows = view(spark, d, "v_sheet_raw")
    return rows.select("o", R.seal_codes(F.array("sellos")).alias("sellos"))


VIEWS["v_curated"] = """
SELECT 'a.csv' AS archivo, doc_id AS linea, ' ' || ean || ' ' AS ean, 'x' AS motivo_actual,
  CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'quizas' ELSE ' ' || upper(estado) END
    AS estado_corregido, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE revisor END AS revisor
FROM v_fix
UNION ALL
SELECT 'b.csv', doc_id, ean, ' ', CASE WHEN doc_id % 3 = 0 THEN 'vegetariano' ELSE '' END, 'b'
FROM v_fix
"""

_CURATED = """SELECT archivo, linea, trim(ean) AS ean, lower(trim(estado_corregido)) AS estado,
  nullif(trim(motivo_actual), '') AS motivo, coalesce(nullif(trim(revisor), ''), 'manual') AS revisor
  FROM v_curated"""


@query(
    "corrections_load",
    f"""SELECT ean, estado, motivo, revisor, archivo FROM (SELECT *, row_number() OVER (PARTITION BY ean
      ORDER BY archivo DESC, linea DESC) AS i FROM ({_CURATED})
      WHERE estado IN ('apto', 'vegetariano', 'no_apto', 'revisar')) WHERE i = 1""",
)
def corrections_load(spark, d):
    return R.load_corrections(view(spark, d, "v_curated"))


@query(
    "corrections_stats",
    f"""SELECT archivo, CASE WHEN estado = '' THEN 'ignorada' WHEN estado IN ('apto', 'vegetariano',
      'no_apto', 'revisar') THEN 'aplicada' ELSE 'invalida' END AS clase, count(*) AS n
    FROM ({_CURATED}) GROUP BY 1, 2""",
)
def corrections_stats(spark, d):
    checked = R.check_corrections(view(spark, d, "v_curated"))
    return checked.groupBy("archivo", "clase").agg(F.count("*").alias("n"))


@query(
    "filter_exclusion_list",
    """SELECT ean, nombre FROM v_catalog WHERE ean NOT IN ('0000000000005', '0000000000042',
    '0000000000117', '7791905023623')""",
)
def filter_exclusion_list(spark, d):
    codes = [*quality.excluded_codes(), "0000000000005", "0000000000042", "0000000000117"]
    return quality.drop_excluded(view(spark, d, "v_catalog"), "ean", codes).select("ean", "nombre")


def shelf_table(spark, d):
    """Shelf rows after the upsert: the last write per code and chain."""
    raw = view(spark, d, "v_shelf_raw").drop("l_orderkey")
    return S.upsert(None, raw, ["ean", "cadena"], ["actualizado", "precio"])


from labelproof.queries.base import CHECK_VIEWS  # noqa: E402

CHECK_VIEWS["o_shelf"] = """SELECT ean, cadena, nombre, marca, categoria, precio, actualizado FROM (
  SELECT *, row_number() OVER (PARTITION BY ean, cadena ORDER BY actualizado DESC, precio DESC) AS i
  FROM v_shelf_raw) WHERE i = 1"""


@query("upsert_last_wins", "SELECT * FROM o_shelf")
def upsert_last_wins(spark, d):
    return shelf_table(spark, d)


def _halves(spark, d):
    raw = view(spark, d, "v_shelf_raw")
    even = F.col("l_orderkey") % 2 == 0
    keyed = raw.select(
        F.concat_ws("/", "ean", "cadena").alias("clave"), "actualizado", "precio", "nombre",
        even.alias("par"),
    )
    old = S.upsert(
        None, keyed.filter("par").drop("par"), ["clave"], ["actualizado", "precio"]
    )
    return old, keyed.filter("NOT par").drop("par")


CHECK_VIEWS["o_halves"] = """SELECT l_orderkey % 2 = 0 AS par, ean || '/' || cadena AS clave,
  actualizado, precio, nombre, row_number() OVER (PARTITION BY ean, cadena, l_orderkey % 2 = 0
  ORDER BY actualizado DESC, precio DESC) AS i FROM v_shelf_raw"""
CHECK_VIEWS["o_merged"] = """SELECT coalesce(a.clave, b.clave) AS clave,
  CASE WHEN a.clave IS NULL THEN 'nueva' WHEN a.actualizado < b.actualizado THEN 'actualizada'
    ELSE 'igual' END AS accion,
  CASE WHEN a.clave IS NULL OR a.actualizado < b.actualizado THEN b.actualizado ELSE a.actualizado END
    AS actualizado,
  CASE WHEN a.clave IS NULL OR a.actualizado < b.actualizado THEN b.precio ELSE a.precio END AS precio,
  coalesce(a.nombre, b.nombre) AS nombre
  FROM (SELECT * FROM o_halves WHERE par AND i = 1) a
  FULL JOIN (SELECT * FROM o_halves WHERE NOT par AND i = 1) b ON a.clave = b.clave"""


@query("merge_newer_wins", "SELECT * FROM o_merged")
def merge_newer_wins(spark, d):
    old, new = _halves(spark, d)
    return S.merge_newer(old, new, "clave", "actualizado")


def _kept(spark, key, schema):
    return KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", key, schema, 16)


@query("upsert_kept_table", "SELECT * FROM o_shelf")
def upsert_kept_table(spark, d):
    """The shelf written in two goes, the older half last, into a kept table, and read back."""
    raw = view(spark, d, "v_shelf_raw")
    even = F.col("l_orderkey") % 2 == 0
    rows = raw.drop("l_orderkey")
    table = _kept(spark, ["ean", "cadena"], rows.schema)
    for half in (raw.filter(~even), raw.filter(even)):
        table.upsert(half.drop("l_orderkey"), ["actualizado", "precio"])
    table.vacuum()
    return table.read()


@query("merge_kept_table", "SELECT clave, actualizado, precio, nombre FROM o_merged")
def merge_kept_table(spark, d):
    """The second half merged into the kept first half."""
    old, new = _halves(spark, d)
    table = _kept(spark, ["clave"], old.schema)
    table.upsert(old, ["actualizado", "precio"])
    table.merge(new, "actualizado")
    return table.read()


@query(
    "merge_stats",
    """SELECT (SELECT count(*) FROM o_halves WHERE NOT par) AS leidas,
      count(*) FILTER (WHERE accion = 'nueva') AS nuevas,
      count(*) FILTER (WHERE accion = 'actualizada') AS actualizadas FROM o_merged""",
)
def merge_stats(spark, d):
    old, new = _halves(spark, d)
    return S.merge_counts(S.merge_newer(old, new, "clave", "actualizado"), new)


@query(
    "registry_prepare",
    r"""SELECT id, rnpa, lower(marca) AS marca_norm, replace(replace(strip_accents(lower(producto)),
      ',', ''), ' - ', ' ') AS producto_norm FROM v_registry""",
)
def registry_prepare(spark, d):
    from labelproof.operators import registry

    rows = registry.prepare(view(spark, d, "v_registry"), "marca", "producto")
    return rows.select("id", "rnpa", "marca_norm", "producto_norm")


def products(spark, d):
    """The bound product table with its chains as an array."""
    rows = view(spark, d, "v_products")
    return rows.withColumn("cadenas", F.split("cadenas", ","))


@query(
    "sink_snapshot",
    """SELECT ean, cadena, nullif(ingredientes, '') AS ingredientes, nullif(trazas, '') AS trazas,
      nullif(sellos, '') AS sellos, CAST(actualizado AS VARCHAR) AS actualizado FROM v_sheet""",
)
def sink_snapshot(spark, d):
    sheets = view(spark, d, "v_sheet")
    return S.snapshot(sheets)


_EXPORT = r"""SELECT ean, trim(regexp_replace(strip_accents(lower(nombre)), '[^a-z0-9]+', '-', 'g'), '-')
    || '-' || ean AS slug, nombre, estado, fuente_decision AS fuente, marca, categoria,
    round_even(confianza, 3) AS confianza, motivo, ingredients_text AS ingredientes,
    CASE WHEN imagen_url LIKE '%/invalid/%' THEN NULL ELSE imagen_url END AS imagen, cadenas
  FROM v_products"""
CHECK_VIEWS["o_export"] = _EXPORT


@query("export_products", "SELECT * FROM o_export")
def export_products(spark, d):
    rows = S.export_products(products(spark, d))
    return rows.withColumn("cadenas", F.array_join("cadenas", ","))


@query(
    "export_summary",
    r"""WITH k AS (
      SELECT 'estado' AS seccion, s.e AS nombre, (SELECT count(*) FROM o_export WHERE estado = s.e) AS n
      FROM (VALUES ('apto'), ('vegetariano'), ('no_apto'), ('revisar')) s(e)
      UNION ALL SELECT 'fuente', fuente, count(*) FROM o_export GROUP BY 2
      UNION ALL SELECT 'categoria', categoria, count(*) FROM o_export WHERE categoria IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'total', 'total', count(*) FROM o_export
      UNION ALL SELECT 'total', 'con_evidencia', count(*) FROM o_export
        WHERE fuente NOT IN ('heuristica', 'ml', 'sin_datos')
      UNION ALL SELECT 'total', 'con_ingredientes', count(ingredientes) FROM o_export
      UNION ALL SELECT 'total', 'confirmados', count(cadenas) FROM o_export)
    SELECT seccion, nombre, CASE WHEN seccion = 'categoria' THEN
      regexp_replace(strip_accents(lower(nombre)), '[^a-z0-9]+', '-', 'g') END AS slug, n FROM k""",
)
def export_summary(spark, d):
    return S.export_summary(S.export_products(products(spark, d)))


_DICT = """SELECT {0} AS v, row_number() OVER (ORDER BY min(ean), {0}) - 1 AS idx FROM o_export
  WHERE {0} IS NOT NULL GROUP BY {0}"""
CHECK_VIEWS["o_marcas"] = _DICT.format("marca")
CHECK_VIEWS["o_categorias"] = _DICT.format("categoria")
CHECK_VIEWS["o_fuentes"] = _DICT.format("fuente")
CHECK_VIEWS["o_chain_seen"] = """SELECT ean, unnest(string_split(cadenas, ',')) AS c,
  generate_subscripts(string_split(cadenas, ','), 1) AS i FROM o_export WHERE cadenas IS NOT NULL"""
CHECK_VIEWS["o_cadenas"] = """SELECT c, row_number() OVER (ORDER BY min(ean || lpad(i::VARCHAR, 3, '0'))) - 1
  AS bit FROM o_chain_seen GROUP BY c"""


@query(
    "index_dict_encode",
    """WITH b AS (SELECT ean, sum(1 << bit)::BIGINT AS bits FROM o_chain_seen s JOIN o_cadenas k ON s.c = k.c
      GROUP BY ean)
    SELECT e.ean, slug, nombre, coalesce(m.idx, -1) AS marca_idx, coalesce(c.idx, -1) AS categoria_idx,
      (CASE estado WHEN 'apto' THEN 0 WHEN 'vegetariano' THEN 1 WHEN 'no_apto' THEN 2 ELSE 3 END)::BIGINT
      AS estado_idx, f.idx AS fuente_idx, coalesce(bits, 0) AS bits,
      (CASE WHEN ingredientes IS NULL THEN 0 ELSE 1 END)::BIGINT AS ingr, coalesce(motivo, '') AS motivo,
      coalesce(replace(imagen, 'https://images.openfoodfacts.org/images/products/', ''), '') AS imagen
    FROM o_export e LEFT JOIN o_marcas m ON m.v = e.marca LEFT JOIN o_categorias c ON c.v = e.categoria
      LEFT JOIN o_fuentes f ON f.v = e.fuente LEFT JOIN b ON b.ean = e.ean""",
)
def index_dict_encode(spark, d):
    rows, _ = S.index_rows(S.export_products(products(spark, d)))
    return rows


@query(
    "index_decode",
    """SELECT ean, slug, nombre, marca, categoria, estado, fuente, coalesce((SELECT string_agg(k.c, ','
      ORDER BY k.bit) FROM o_chain_seen s JOIN o_cadenas k ON s.c = k.c WHERE s.ean = e.ean), '') AS cadenas,
      ingredientes IS NOT NULL AS con_ingredientes, motivo,
      imagen FROM o_export e""",
)
def index_decode(spark, d):
    decoded = S.decode_index(*S.index_rows(S.export_products(products(spark, d))))
    return decoded.withColumn("cadenas", F.array_join("cadenas", ","))
