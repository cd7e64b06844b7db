"""Product-shaped views over the supplied tables.

Each view is one SQL text that means the same in Spark and in the checking
engine; ``LISTAGG[value|separator|order]`` is the one dialect difference. The
invented part names (adjective, noun) stand for food words, so the production
rules run on every row: ``red rod`` is ``leche de coco``, ``old rod`` is
``Saborizante: leche``. Variants of a value are spread over the rows by key;
no view leaves rows out to get smaller.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["v_part0"] = """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice,
  lpad(cast(p_partkey AS varchar(20)), 13, '0') AS ean,
  split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun,
  replace(p_brand, 'Brand#', '') AS brand_no,
  CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'gelatina' WHEN 'rod' THEN 'leche'
    WHEN 'ring' THEN 'Miel' WHEN 'gizmo' THEN 'lecitina' WHEN 'widget' THEN 'harina de trigo'
    WHEN 'gear' THEN 'azúcar' WHEN 'plate' THEN 'aceite de girasol' ELSE 'zumaque' END AS base,
  CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'gelatin' WHEN 'rod' THEN 'milk'
    WHEN 'ring' THEN 'honey' WHEN 'gizmo' THEN 'lecithin' WHEN 'widget' THEN 'wheat-flour'
    WHEN 'gear' THEN 'sugar' WHEN 'plate' THEN 'sunflower-oil' ELSE 'sumac' END AS base_tag
FROM part
"""

VIEWS["v_part"] = """
SELECT p.*,
  CASE adj WHEN 'red' THEN base || ' de coco' WHEN 'blue' THEN base || ' artificial'
    WHEN 'hot' THEN 'sabor ' || base WHEN 'old' THEN 'Saborizante: ' || base
    WHEN 'cold' THEN base || ' 20%' WHEN 'large' THEN base || ' y sal'
    WHEN 'new' THEN base || ' (INS 330)' ELSE upper(base) END AS food,
  CASE adj WHEN 'red' THEN 'en:coconut-' || base_tag
    WHEN 'blue' THEN 'es:' || replace(lower(base), ' ', '-') || '-artificial'
    WHEN 'hot' THEN 'es:sabor-' || replace(lower(base), ' ', '-') WHEN 'old' THEN 'en:colour'
    WHEN 'cold' THEN 'en:' || base_tag WHEN 'large' THEN 'en:' || base_tag || '-and-salt'
    WHEN 'new' THEN 'en:e330' ELSE 'en:' || upper(base_tag) END AS tag,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
    WHEN p_size % 7 = 0 THEN '[''Bránd ' || brand_no || ''']'
    WHEN p_size % 7 = 1 THEN 'BRAND ' || brand_no WHEN p_size % 7 = 2 THEN 'brand ' || brand_no
    WHEN p_size % 7 = 3 THEN 'Brand ' || brand_no || ' %'
    WHEN p_size % 7 = 4 THEN 'Brand ' || brand_no || ' ,Otra'
    ELSE 'Brand ' || brand_no END AS marca
FROM v_part0 p
"""

VIEWS["v_catalog"] = """
SELECT ean, food AS nombre, marca, p_type AS categoria, p_retailprice AS precio_ref,
  p_partkey, p_type, p_size, p_name, adj, noun, base
FROM v_part
"""

# The catalog of the build: promotional parts are known to the shops only.
VIEWS["v_listed"] = """
SELECT ean, nombre, marca, precio_ref FROM v_catalog WHERE p_type <> 'PROMO'
"""

VIEWS["v_shelf_raw"] = """
SELECT p.ean,
  CASE l_suppkey % 5 WHEN 0 THEN 'carrefour' WHEN 1 THEN 'vea' WHEN 2 THEN 'dia'
    WHEN 3 THEN 'jumbo' ELSE 'disco' END AS cadena,
  p.food AS nombre,
  CASE WHEN l_suppkey % 5 = 2 THEN ' ' ELSE 'BRAND ' || p.brand_no END AS marca,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Almacén' WHEN p.p_type = 'PROMO' THEN 'Lácteos'
    WHEN p.p_type = 'ECONOMY' THEN 'Congelados' WHEN p.p_type = 'LARGE' THEN ' Panadería'
    WHEN p.p_type = 'SMALL' THEN 'Frescos' ELSE NULL END AS categoria,
  floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS precio,
  cast(cast(l_shipdate AS date) AS varchar(10)) AS actualizado,
  l_orderkey
FROM lineitem JOIN v_part p ON l_partkey = p.p_partkey
"""

VIEWS["v_line"] = """
SELECT l_orderkey AS o, p.food, p.tag, p.base, p.p_name, p.p_type, p.ean, p.adj, p.noun,
  l_linenumber, l_suppkey, l_extendedprice, l_shipdate,
  lpad(cast(l_linenumber AS varchar(20)), 4, '0') || lpad(cast(l_partkey AS varchar(20)), 9, '0')
    || lpad(cast(l_suppkey AS varchar(20)), 9, '0') AS k
FROM lineitem JOIN v_part p ON l_partkey = p.p_partkey
"""

VIEWS["v_codes"] = """
SELECT o, k, food, adj,
  CASE l_linenumber % 6 WHEN 0 THEN ean WHEN 1 THEN ean || '.0'
    WHEN 2 THEN substring(ean, 1, 6) || '-' || substring(ean, 7, 7) WHEN 3 THEN substring(ean, 8, 6)
    WHEN 4 THEN substring(ean, 2, 12) ELSE '42' || substring(ean, 11, 3) || 'E9' END AS codigo,
  CASE WHEN l_suppkey % 13 = 0 THEN 'n/d' ELSE
    cast(cast(floor(cents / 100) AS bigint) AS varchar(20)) || ','
    || lpad(cast(cents % 100 AS varchar(20)), 2, '0') END AS precio_texto,
  CASE WHEN l_suppkey % 7 = 0 THEN '   ' ELSE '  Marca   ' || adj || ' ' END AS marca_texto
FROM (SELECT l.*, cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS cents FROM v_line l) x
"""

VIEWS["v_label"] = """
SELECT o, lpad(cast(o AS varchar(20)), 13, '0') AS ean,
  LISTAGG[food|, |k] || CASE o % 6 WHEN 1 THEN '. Puede contener trazas de leche'
    WHEN 3 THEN '. PUEDE CONTENER miel' WHEN 5 THEN '; contiene trazas de gelatina.' ELSE '' END AS txt,
  LISTAGG[tag|,|k] || CASE o % 6 WHEN 1 THEN ',en:milk' WHEN 3 THEN ',en:honey'
    WHEN 5 THEN ',en:gelatin' ELSE '' END AS tags,
  cast(cast(max(l_shipdate) AS date) AS varchar(10)) AS fecha
FROM v_line GROUP BY o
"""

VIEWS["v_payload"] = """
SELECT o, ean, o % 10 <> 3 AS found,
  CASE WHEN o % 3 = 2 THEN '' ELSE txt END AS off_txt,
  CASE WHEN o % 4 = 3 THEN '' ELSE tags END AS off_tags,
  CASE o % 7 WHEN 0 THEN 'en:non-vegan' WHEN 1 THEN 'en:vegan'
    WHEN 2 THEN 'en:non-vegan,en:vegetarian' WHEN 3 THEN 'en:vegan-status-unknown'
    WHEN 4 THEN 'en:vegetarian' WHEN 5 THEN 'en:non-vegetarian' ELSE '' END AS off_analysis,
  CASE WHEN o % 13 = 0 THEN 'en:organic,en:vegan' WHEN o % 13 = 1 THEN 'en:organic' ELSE '' END
    AS off_labels,
  CASE o % 5 WHEN 0 THEN 'en:dairies,en:milks' WHEN 1 THEN 'en:sugars' WHEN 2 THEN 'xx:nada'
    ELSE '' END AS off_categories,
  CASE o % 5 WHEN 0 THEN 'https://images.openfoodfacts.org/images/products/' || ean
    WHEN 1 THEN 'https://images.openfoodfacts.org/images/products/invalid/' || ean
    WHEN 2 THEN 'https://example.org/' || ean ELSE '' END AS off_image
FROM v_label
"""

VIEWS["v_cache"] = """
SELECT ean, found,
  '{"code":"' || ean || '","ingredients_text":"' || off_txt || '","ingredients_tags":['
  || CASE WHEN off_tags = '' THEN '' ELSE '"' || replace(off_tags, ',', '","') || '"' END
  || '],"ingredients_analysis_tags":['
  || CASE WHEN off_analysis = '' THEN '' ELSE '"' || replace(off_analysis, ',', '","') || '"' END
  || '],"labels_tags":['
  || CASE WHEN off_labels = '' THEN '' ELSE '"' || replace(off_labels, ',', '","') || '"' END
  || '],"categories_tags":['
  || CASE WHEN off_categories = '' THEN '' ELSE '"' || replace(off_categories, ',', '","') || '"' END
  || '],"image_front_small_url":'
  || CASE WHEN off_image = '' THEN 'null' ELSE '"' || off_image || '"' END || '}' AS payload
FROM v_payload
"""

VIEWS["v_sheet"] = """
SELECT lpad(cast(CASE WHEN o = 0 THEN 999999999999 ELSE o - 1 END AS varchar(20)), 13, '0') AS ean, o,
  CASE o % 3 WHEN 0 THEN 'disco' WHEN 1 THEN 'jumbo' ELSE 'vea' END AS cadena,
  CASE WHEN o % 4 = 3 THEN NULL ELSE txt END AS ingredientes,
  CASE WHEN o % 4 = 1 THEN 'soja' ELSE NULL END AS trazas,
  CASE o % 9 WHEN 0 THEN 'kosher,vegan' WHEN 1 THEN 'gluten_free,kosher'
    WHEN 2 THEN 'gluten_free,vegan,vegetarian' WHEN 3 THEN 'vegan_friendly' ELSE NULL END AS sellos,
  fecha AS actualizado
FROM v_label
"""

# All sheets under every second code, so that shelf codes without a sheet remain.
VIEWS["v_fetched"] = """
SELECT lpad(cast(o * 2 AS varchar(20)), 13, '0') AS ean, cadena, ingredientes, trazas, sellos, actualizado FROM v_sheet
"""

VIEWS["v_registry"] = """
SELECT p_partkey AS id, 'BRAND ' || brand_no AS marca,
  'Producto a base de ' || base || ', sabor dulce de ' || adj || ' - ' || adj || ' clásico' AS producto,
  'R' || cast(p_partkey AS varchar(20)) AS rnpa, p_size
FROM v_part
"""

# The registry of the build: all rows; larger sizes belong to brands that no product has,
# so that the sources behind the registry still decide some rows.
VIEWS["v_registered"] = """
SELECT id, CASE WHEN p_size <= 2 THEN marca ELSE 'AJENA ' || cast(id AS varchar(20)) END AS marca, producto, rnpa
FROM v_registry
"""

VIEWS["v_fix"] = """
SELECT lpad(cast(doc_id AS varchar(20)), 13, '0') AS ean, doc_id,
  CASE WHEN toxic = 1 THEN 'no_apto' WHEN quality = 1 THEN 'apto' ELSE 'revisar' END AS estado,
  'rev' || cast(doc_id % 3 AS varchar(20)) AS revisor
FROM labels
"""

VIEWS["v_products"] = """
SELECT p.ean, p.food AS nombre, p.marca,
  CASE p.noun WHEN 'rod' THEN 'Lácteos' WHEN 'gear' THEN 'Azúcar y endulzantes'
    WHEN 'bolt' THEN NULL WHEN 'anvil' THEN 'Postres y helados' ELSE 'Otros' END AS categoria,
  CASE WHEN p.adj IN ('hot', 'old') THEN 'revisar' WHEN p.noun = 'anvil' THEN 'no_apto'
    WHEN p.noun IN ('rod', 'ring') AND p.p_type <> 'PROMO' THEN 'vegetariano'
    WHEN p.noun = 'gizmo' THEN 'revisar' ELSE 'apto' END AS estado,
  CASE p.p_size % 9 WHEN 0 THEN 'certificacion_oficial' WHEN 1 THEN 'off_label'
    WHEN 2 THEN 'sello_super' WHEN 3 THEN 'ingredientes' WHEN 4 THEN 'ingredientes_super'
    WHEN 5 THEN 'off_analysis' WHEN 6 THEN 'heuristica' WHEN 7 THEN 'ml' ELSE 'sin_datos' END
    AS fuente_decision,
  CASE WHEN p.p_size % 9 = 7 THEN cast(p.p_partkey % 997 AS double) / cast(997 AS double) ELSE NULL END AS confianza,
  l.txt AS ingredients_text,
  CASE p.p_size % 3 WHEN 0 THEN 'https://images.openfoodfacts.org/images/products/' || p.ean
    WHEN 1 THEN 'https://images.openfoodfacts.org/images/products/invalid/' || p.ean
    ELSE NULL END AS imagen_url,
  'Contiene ' || lower(p.base) || ': es un ejemplo' AS motivo,
  CASE p.p_size % 4 WHEN 0 THEN 'carrefour,vea' WHEN 1 THEN 'dia'
    WHEN 2 THEN 'carrefour,disco,jumbo' ELSE NULL END AS cadenas,
  p.p_retailprice AS precio_ref, p.p_partkey, p.p_type, p.p_size, p.adj, p.noun
FROM v_part p LEFT JOIN v_label l ON l.ean = p.ean AND p.p_size % 5 <> 0
"""

VIEWS["v_queries"] = """
SELECT DISTINCT p_name AS q_id,
  CASE adj WHEN 'red' THEN base WHEN 'blue' THEN substring(food, 1, 4)
    WHEN 'hot' THEN base || ' Brand' WHEN 'old' THEN 'brand 1' WHEN 'cold' THEN food
    WHEN 'large' THEN '' WHEN 'new' THEN 'inexistente ' || base
    ELSE CASE WHEN noun = 'rod' THEN ' sal ' ELSE '0000000000042' END END AS q_texto,
  CASE noun WHEN 'rod' THEN 'Lácteos' WHEN 'gear' THEN 'Postres y helados' ELSE NULL END
    AS q_categoria,
  noun = 'ring' AS q_confirmados, noun = 'gizmo' AS q_con_ingredientes,
  noun IN ('anvil', 'gear') AS q_registro,
  CASE noun WHEN 'bolt' THEN 'apto,vegetariano' WHEN 'plate' THEN 'no_apto' WHEN 'ring' THEN 'apto'
    ELSE NULL END AS q_estados
FROM v_part
"""

VIEWS["v_votes"] = """
SELECT marca, count(*) AS n FROM v_catalog WHERE trim(marca) <> '' GROUP BY marca
"""

VIEWS["v_shelf_votes"] = """
SELECT marca, count(*) AS n FROM v_shelf_raw WHERE trim(marca) <> '' GROUP BY marca
UNION ALL
SELECT marca, count(*) AS n FROM (
  SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'NATIVA ' || cast(s_nationkey AS varchar(20))
    WHEN s_suppkey % 3 = 1 THEN 'Nativa ' || cast(s_nationkey AS varchar(20))
    ELSE 'Natíva ' || cast(s_nationkey AS varchar(20)) END AS marca FROM supplier) x
GROUP BY marca
"""

VIEWS["v_log"] = """
SELECT event_id AS pos, cast(cast(ts AS date) AS varchar(10)) AS dia, user_id, event_type,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'view' THEN 206 ELSE 200 END
    AS status,
  event_type <> 'purchase' OR user_id % 2 = 0 AS json_ok,
  event_type <> 'click' OR user_id % 3 > 0 AS hallado
FROM events
"""

VIEWS["v_tree"] = """
SELECT 'r' || cast(r_regionkey AS varchar(20)) AS id, cast(NULL AS varchar(40)) AS parent,
  CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 'Bebidas de ' || r_name WHEN r_name = 'EUROPE'
    THEN 'Lácteos' WHEN r_name = 'AMERICA' THEN 'Almacén' ELSE 'Hogar' END AS nombre,
  (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey = r_regionkey) AS total, false AS hoja
FROM region
UNION ALL
SELECT 'n' || cast(n_nationkey AS varchar(20)), 'r' || cast(min(n_regionkey) AS varchar(20)),
  min(n_name), count(c_custkey), false
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
UNION ALL
SELECT 's' || cast(c_nationkey AS varchar(20)) || c_mktsegment,
  'n' || cast(c_nationkey AS varchar(20)), c_mktsegment, count(*), true
FROM customer GROUP BY c_nationkey, c_mktsegment
"""

_NAME = re.compile(r"\b[vo]_[a-z0-9_]+\b")
_LIST = re.compile(r"LISTAGG\[([^|\]]+)\|([^|\]]+)\|([^|\]]+)\]")


def _ordered(sql: str, known: dict[str, str], seen: list[str]) -> None:
    for name in _NAME.findall(sql):
        if name in known and name not in seen:
            _ordered(known[name], known, seen)
            seen.append(name)


def with_views(sql: str, known: dict[str, str], dialect: str) -> str:
    """Query text preceded by the views it names, in order of need."""
    names: list[str] = []
    _ordered(sql, known, names)
    form = (
        r"listagg(\1, '\2') WITHIN GROUP (ORDER BY \3)"
        if dialect == "spark"
        else r"string_agg(\1, '\2' ORDER BY \3)"
    )
    parts = [f"{n} AS ({_LIST.sub(form, known[n]).strip()})" for n in names]
    body = _LIST.sub(form, sql).strip()
    if not parts:
        return body
    if body.startswith("WITH"):
        body = f"SELECT * FROM ({body}) q"
    return "WITH " + ",\n".join(parts) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Query text over the views as a DataFrame."""
    needed = set(re.findall(r"\b[a-z]+\b", with_views(text, VIEWS, "spark")))
    for name in TABLES:
        if name in needed:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(with_views(text, VIEWS, "spark"))
