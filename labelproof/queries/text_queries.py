"""Normalisation and display queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelproof.bindings.views import sql, view
from labelproof.functions import display as D
from labelproof.functions import text as T
from labelproof.queries.base import query


@query(
    "norm_name",
    r"""SELECT doc_id, trim(regexp_replace(replace(strip_accents(lower(text)), '-', ' '),
    '\s+', ' ', 'g')) AS clave FROM documents""",
)
def norm_name(spark, d):
    docs = sql(spark, d, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", T.norm_name(F.col("text")).alias("clave"))


@query(
    "norm_ingredients",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(
      replace(strip_accents(lower(text)), '_', ' '), '\b(ins|e)[\s.-]*(\d{3,4})\b', '\1 \2', 'g'),
      '\b(aro|col|aci|acreg|ant|cons|emu|esp|est|edu|hum|leu|gas|sec|reg|anah|exa|flo|sab)[\s.-]+(\d{3,4})\b',
      '\1 ins \2', 'g'), '\s+', ' ', 'g')) AS texto FROM documents""",
)
def norm_ingredients(spark, d):
    docs = sql(spark, d, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", T.norm_ingredients(F.col("text")).alias("texto"))


@query(
    "norm_registry",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)),
    '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clave FROM documents""",
)
def norm_registry(spark, d):
    docs = sql(spark, d, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", T.norm_registry(F.col("text")).alias("clave"))


@query(
    "token_set",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'))
      AS t FROM documents),
    k AS (SELECT DISTINCT doc_id, t FROM w WHERE length(t) > 2 AND t NOT IN ('del', 'los', 'las',
      'con', 'sin', 'para', 'por', 'sabor', 'grs', 'una', 'libre', 'gluten', 'tacc', 'apto',
      'producto', 'untable'))
    SELECT d.doc_id, coalesce(s.tokens, '') AS tokens FROM documents d LEFT JOIN
      (SELECT doc_id, string_agg(t, ' ' ORDER BY t) AS tokens FROM k GROUP BY doc_id) s
      ON s.doc_id = d.doc_id""",
)
def token_set(spark, d):
    docs = sql(spark, d, "SELECT doc_id, text FROM documents")
    tokens = F.array_join(T.token_set(F.col("text")), " ")
    return docs.select("doc_id", tokens.alias("tokens"))


@query(
    "clause_tokens",
    r"""SELECT id, producto, CASE WHEN adj < 'dulce' THEN adj || ' dulce' ELSE 'dulce ' || adj END
    AS tokens FROM (SELECT id, producto,
      regexp_extract(producto, 'sabor dulce de (\w+)', 1) AS adj FROM v_registry)""",
)
def clause_tokens(spark, d):
    rows = view(spark, d, "v_registry")
    tokens = F.array_join(T.clause_tokens(F.col("producto")), " ")
    return rows.select("id", "producto", tokens.alias("tokens"))


@query(
    "brand_clean",
    r"""SELECT ean, nullif(trim(regexp_replace(regexp_replace(regexp_replace(
      CASE WHEN marca LIKE '[''%'']' THEN substring(marca, 3, length(marca) - 4) ELSE marca END,
      '\s*,\s*', ', ', 'g'), '\s*%\s*$', ''), '\s+', ' ', 'g'), ' ,-'), '') AS marca
    FROM v_catalog""",
)
def brand_clean(spark, d):
    rows = view(spark, d, "v_catalog")
    return rows.select("ean", T.brand_clean(F.col("marca")).alias("marca"))


@query(
    "brand_key",
    r"""SELECT ean, coalesce(trim(regexp_replace(strip_accents(lower(marca)), '[^a-z0-9]+', ' ', 'g')),
    '') AS clave FROM v_catalog""",
)
def brand_key(spark, d):
    rows = view(spark, d, "v_catalog")
    return rows.select("ean", T.brand_key(F.col("marca")).alias("clave"))


_EAN_CHECK = r"""CASE WHEN codigo LIKE '%E9' THEN lpad(substring(codigo, 1, length(codigo) - 2)
      || '000000000', CASE WHEN length(codigo) <= 5 THEN 13 ELSE length(codigo)::INTEGER + 7 END, '0')
    WHEN length(regexp_replace(replace(codigo, '.0', ''), '\D', '', 'g')) < 8 THEN NULL
    ELSE lpad(regexp_replace(replace(codigo, '.0', ''), '\D', '', 'g'), 13, '0') END"""


@query("ean_normalize", f"SELECT o, k, codigo, {_EAN_CHECK} AS ean FROM v_codes")
def ean_normalize(spark, d):
    rows = view(spark, d, "v_codes")
    return rows.select("o", "k", "codigo", T.ean_normalize(F.col("codigo")).alias("ean"))


@query(
    "price_parse",
    """SELECT o, k, precio_texto, try_cast(replace(precio_texto, ',', '.') AS DOUBLE) AS precio
    FROM v_codes""",
)
def price_parse(spark, d):
    rows = view(spark, d, "v_codes")
    return rows.select("o", "k", "precio_texto", T.price_parse(F.col("precio_texto")).alias("precio"))


_SLUG_CHECK = r"""coalesce(nullif(substring(trim(regexp_replace(lower(regexp_replace(
    strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 70), ''),
    'producto')"""


@query("slugify", f"SELECT doc_id, {_SLUG_CHECK.format('text')} AS slug FROM documents")
def slugify(spark, d):
    docs = sql(spark, d, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(
    "tag_body",
    r"""SELECT o, k, tag, trim(regexp_replace(replace(strip_accents(lower(split_part(tag, ':', 2))),
    '-', ' '), '\be(\d{3})\b', 'e \1', 'g')) AS texto FROM v_line""",
)
def tag_body(spark, d):
    rows = view(spark, d, "v_line")
    return rows.select("o", "k", "tag", T.tag_text(F.col("tag")).alias("texto"))


@query(
    "display_numbers",
    r"""WITH t AS (SELECT p_brand, count(*) AS n, count(*) * 12345 AS grande FROM lineitem
      JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
    s AS (SELECT *, (SELECT sum(n) FROM t)::BIGINT AS total FROM t)
    SELECT p_brand, replace(format('{:,}', grande), ',', '.') AS miles,
      cast(floor(floor(100.0::DOUBLE * n / total * 10 + 0.5) / 10) AS BIGINT) || ','
      || cast(floor(100.0::DOUBLE * n / total * 10 + 0.5)::BIGINT % 10 AS VARCHAR) || '%' AS parte
    FROM s
    UNION ALL SELECT 'vacio', '0', '0%'""",
)
def display_numbers(spark, d):
    rows = sql(
        spark, d,
        "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    )
    total = rows.agg(F.sum("n").alias("t")).scalar()
    shown = rows.select(
        "p_brand",
        D.thousands(F.col("n") * 12345).alias("miles"),
        D.percentage(F.col("n"), total).alias("parte"),
    )
    # The total of no rows is the empty case of a share.
    empty = rows.filter(F.col("n") < 0).agg(F.count("*").alias("n"))
    return shown.unionByName(
        empty.select(
            F.lit("vacio").alias("p_brand"),
            D.thousands(F.col("n")).alias("miles"),
            D.percentage(F.col("n"), F.col("n")).alias("parte"),
        )
    )
