"""Brand and category queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.bindings.views import view
from labelproof.operators import brands as B
from labelproof.operators import candidates as J
from labelproof.operators import categories as C
from labelproof.queries.base import CHECK_VIEWS, query
from labelproof.queries.quality_queries import build_inputs
from labelproof.queries.source_queries import shelf_table

_CLEAN = r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN {0} LIKE '[''%'']'
  THEN substring({0}, 3, length({0}) - 4) ELSE {0} END, '\s*,\s*', ', ', 'g'), '\s*%\s*$', ''), '\s+', ' ', 'g'),
  ' ,-'), '')"""
_KEY = r"coalesce(trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g')), '')"
CHECK_VIEWS["o_spell"] = f"""SELECT fuente, marca, n, {_CLEAN.format('marca')} AS limpia,
  {_KEY.format(_CLEAN.format('marca'))} AS clave FROM (SELECT 1 AS fuente, * FROM v_votes
    UNION ALL SELECT 2, * FROM v_shelf_votes)"""
CHECK_VIEWS["o_voto"] = """SELECT clave, limpia, sum(n)::BIGINT AS n, bool_or(lower(limpia) <> limpia AND
    upper(limpia) <> limpia) AS mixta FROM o_spell WHERE fuente = 1 OR clave NOT IN (SELECT clave FROM o_spell
    WHERE fuente = 1) GROUP BY 1, 2"""
CHECK_VIEWS["o_cand"] = """SELECT *, sum(n) OVER (PARTITION BY clave) AS total FROM (SELECT *, bool_or(mixta)
    OVER (PARTITION BY clave) AS hay FROM o_voto) WHERE mixta OR NOT hay"""
CHECK_VIEWS["o_canon"] = """SELECT clave, limpia AS canonica FROM (SELECT *, row_number() OVER (PARTITION BY clave
    ORDER BY (strip_accents(limpia) <> limpia AND n >= greatest(3, floor(total * 0.1))) DESC, n DESC,
    length(limpia), limpia DESC) AS i FROM o_cand) WHERE i = 1"""
CHECK_VIEWS["o_map"] = """SELECT DISTINCT marca, canonica FROM o_spell s JOIN o_canon c ON c.clave = s.clave"""


def _votes(spark, d):
    return view(spark, d, "v_votes"), view(spark, d, "v_shelf_votes")


@query("brand_canonical", "SELECT * FROM o_canon")
def brand_canonical(spark, d):
    first, second = _votes(spark, d)
    known = first.select(B.T.brand_key(F.col("marca")).alias("clave")).distinct()
    keyed = second.withColumn("clave", B.T.brand_key(F.col("marca")))
    others = keyed.join(known, "clave", "left_anti").select("marca", "n")
    return B.canonical(first.unionByName(others))


@query("brand_map", "SELECT * FROM o_map")
def brand_map(spark, d):
    return B.brand_map(*_votes(spark, d)).select("marca", "canonica")


@query(
    "brand_apply",
    f"""SELECT ean, coalesce(m.canonica, k.canonica, {_CLEAN.format('c.marca')}) AS marca FROM v_catalog c
      LEFT JOIN o_map m ON m.marca = c.marca LEFT JOIN o_map k ON k.marca = {_CLEAN.format('c.marca')}""",
)
def brand_apply(spark, d):
    mapping = B.brand_map(*_votes(spark, d))
    rows = view(spark, d, "v_catalog").select("ean", "marca")
    return B.apply_map(rows, "marca", mapping, F.col("ean"), "unificada").select(
        "ean", F.col("unificada").alias("marca")
    )


@query(
    "brand_fill",
    f"""WITH g AS (SELECT ean, arg_min(trim(marca), CASE cadena WHEN 'carrefour' THEN 0 WHEN 'vea' THEN 1
        WHEN 'dia' THEN 2 WHEN 'jumbo' THEN 3 ELSE 4 END) FILTER (WHERE trim(marca) <> '') AS marca
      FROM o_shelf GROUP BY ean),
    f AS (SELECT c.ean, coalesce(c.marca, g.marca) AS marca FROM v_catalog c LEFT JOIN g ON g.ean = c.ean)
    SELECT f.ean, coalesce(m.canonica, {_CLEAN.format('f.marca')}) AS marca FROM f LEFT JOIN o_map m
      ON m.marca = f.marca""",
)
def brand_fill(spark, d):
    mapping = B.brand_map(*_votes(spark, d))
    shelf = J.shelf_features(shelf_table(spark, d))
    rows = view(spark, d, "v_catalog").select("ean", "marca").join(shelf, "ean", "left")
    rows = rows.withColumn("llena", B.fill_brand(F.col("marca"), F.col("marca_gondola")))
    return B.apply_map(rows, "llena", mapping, F.col("ean"), "unificada").select(
        "ean", F.col("unificada").alias("marca")
    )


# The production rules over the bound food words.
_TAG_CAT = """CASE WHEN {0} LIKE '%en:dairies%' THEN 'Lácteos' WHEN {0} LIKE '%en:sugars%' THEN
  'Azúcar y endulzantes' END"""
_NAME_CAT = r"""CASE WHEN {0} ILIKE '%leche de coco%' THEN 'Bebidas vegetales'
  WHEN {0} ILIKE '%gelatina%' THEN 'Postres y helados'
  WHEN {0} ILIKE '%azúcar%' THEN 'Azúcar y endulzantes'
  WHEN {0} ILIKE '%aceite%' THEN 'Aceites y grasas' WHEN {0} ILIKE '%miel%' THEN 'Untables y mermeladas'
  WHEN {0} ILIKE '%leche%' THEN 'Lácteos' WHEN {0} ILIKE '%harina%' THEN 'Cereales, pastas y legumbres' END"""
_SHELF_CAT = """CASE trim({0}) WHEN 'Lácteos' THEN 'Lácteos' WHEN 'Congelados' THEN 'Congelados'
  WHEN 'Panadería' THEN 'Panificados' END"""


@query("category_from_tags", f"SELECT ean, {_TAG_CAT.format('off_categories')} AS categoria FROM v_payload")
def category_from_tags(spark, d):
    rows = view(spark, d, "v_payload")
    return rows.select("ean", C.from_tags(F.split("off_categories", ",")).alias("categoria"))


@query("category_from_name", f"SELECT ean, nombre, {_NAME_CAT.format('nombre')} AS categoria FROM v_catalog")
def category_from_name(spark, d):
    rows = view(spark, d, "v_catalog")
    return rows.select("ean", "nombre", C.from_name(F.col("nombre")).alias("categoria"))


@query("category_from_shelf", f"SELECT ean, cadena, {_SHELF_CAT.format('categoria')} AS rubro FROM o_shelf")
def category_from_shelf(spark, d):
    rows = shelf_table(spark, d)
    return rows.select("ean", "cadena", C.from_shelf(F.col("categoria")).alias("rubro"))


CHECK_VIEWS["o_shelf_cat"] = f"""SELECT ean, arg_min({_SHELF_CAT.format('categoria')}, CASE cadena
    WHEN 'carrefour' THEN 0 WHEN 'vea' THEN 1 WHEN 'dia' THEN 2 WHEN 'jumbo' THEN 3 ELSE 4 END)
    FILTER (WHERE {_SHELF_CAT.format('categoria')} IS NOT NULL) AS rubro FROM o_shelf GROUP BY ean"""


@query(
    "category_final",
    f"""SELECT c.ean, coalesce({_TAG_CAT.format('off_categories')}, {_NAME_CAT.format('nombre')}, s.rubro,
      'Otros') AS categoria FROM v_catalog c LEFT JOIN v_payload p ON p.ean = c.ean
      LEFT JOIN o_shelf_cat s ON s.ean = c.ean""",
)
def category_final(spark, d):
    payload = view(spark, d, "v_payload").select("ean", "off_categories")
    shelf = J.shelf_features(shelf_table(spark, d)).select("ean", "gondola")
    rows = view(spark, d, "v_catalog").join(payload, "ean", "left").join(shelf, "ean", "left")
    tags = F.split("off_categories", ",")
    return rows.select("ean", C.final(tags, F.col("nombre"), F.col("gondola")).alias("categoria"))


# The brand map of the build votes with the reduced tables.
CHECK_VIEWS["o_fspell"] = f"""SELECT fuente, marca, n, {_CLEAN.format('marca')} AS limpia,
  {_KEY.format(_CLEAN.format('marca'))} AS clave FROM (
    SELECT 1 AS fuente, marca, count(*) AS n FROM v_listed WHERE trim(marca) <> '' GROUP BY marca
    UNION ALL SELECT 2, marca, count(*) FROM o_shelf WHERE trim(marca) <> '' GROUP BY marca)"""
CHECK_VIEWS["o_fvoto"] = CHECK_VIEWS["o_voto"].replace("o_spell", "o_fspell")
CHECK_VIEWS["o_fcand"] = CHECK_VIEWS["o_cand"].replace("o_voto", "o_fvoto")
CHECK_VIEWS["o_fcanon"] = CHECK_VIEWS["o_canon"].replace("o_cand", "o_fcand")
CHECK_VIEWS["o_fmap"] = """SELECT DISTINCT marca, canonica FROM o_fspell s JOIN o_fcanon c ON c.clave = s.clave"""
CHECK_VIEWS["o_features"] = f"""WITH g AS (SELECT ean, arg_min(trim(marca), CASE cadena WHEN 'carrefour' THEN 0
      WHEN 'vea' THEN 1 WHEN 'dia' THEN 2 WHEN 'jumbo' THEN 3 ELSE 4 END) FILTER (WHERE trim(marca) <> '') AS m
    FROM o_shelf GROUP BY ean),
  f AS (SELECT u.*, coalesce(u.marca, g.m) AS llena FROM o_universe u LEFT JOIN g ON g.ean = u.ean)
  SELECT f.ean, f.nombre, f.precio_ref, coalesce(m.canonica, {_CLEAN.format('f.llena')}) AS marca,
    coalesce(CASE WHEN p.found AND l.ean IS NOT NULL THEN {_TAG_CAT.format('p.off_categories')} END,
      {_NAME_CAT.format('f.nombre')}, s.rubro, 'Otros') AS categoria,
    h.ingredientes AS ficha_ingredientes, h.sellos AS ficha_sellos, h.o AS ficha_o,
    CASE WHEN p.found AND l.ean IS NOT NULL THEN p.o END AS payload_o
  FROM f LEFT JOIN o_fmap m ON m.marca = f.llena LEFT JOIN v_listed l ON l.ean = f.ean
    LEFT JOIN v_payload p ON p.ean = f.ean LEFT JOIN o_shelf_cat s ON s.ean = f.ean
    LEFT JOIN v_sheet h ON h.ean = f.ean"""


@query(
    "candidate_features",
    "SELECT ean, nombre, marca, categoria, precio_ref, ficha_ingredientes, ficha_sellos FROM o_features",
)
def candidate_features(spark, d):
    from labelproof.sources.readers import parse_payload

    catalog, cache, shelf, sheets = build_inputs(spark, d)
    listed = parse_payload(J.universe(catalog, cache, shelf, sheets))
    return J.features(listed, catalog, shelf, sheets).select(
        "ean", "nombre", "marca", "categoria", "precio_ref", "ficha_ingredientes", "ficha_sellos"
    )
