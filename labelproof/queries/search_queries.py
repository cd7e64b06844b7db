"""Search and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelproof.bindings.views import VIEWS, sql, view
from labelproof.operators import ingredients as I
from labelproof.operators import model as M
from labelproof.operators import postings as P
from labelproof.operators import search as S
from labelproof.operators.skew import reliable, shared_folder
from labelproof.queries.base import CHECK_VIEWS, query
from labelproof.queries.source_queries import products


def asked(spark, d):
    """The searches with their verdict sets as arrays."""
    return view(spark, d, "v_queries").withColumn("q_estados", F.split("q_estados", ","))


CHECK_VIEWS["o_q"] = """SELECT *, strip_accents(lower(trim(q_texto))) AS q,
    regexp_full_match(trim(q_texto), '\\d{8,14}') AS codigo FROM v_queries"""
CHECK_VIEWS["o_p"] = """SELECT *, ' ' || strip_accents(lower(nombre)) AS n, ' ' || strip_accents(lower(nombre))
    || coalesce(' ' || strip_accents(lower(marca)), '') AS w FROM v_products"""
CHECK_VIEWS["o_pair"] = """SELECT q_id, q, codigo, q_categoria, q_estados, q_confirmados, q_con_ingredientes, q_registro,
    p.ean, p.nombre, p.estado,
    list_filter(string_split(q, ' '), lambda t: t <> '') AS ts, n, w,
    q_categoria IS NULL OR coalesce(categoria = q_categoria, false) AS f_categoria,
    NOT q_con_ingredientes OR coalesce(ingredients_text, '') <> '' AS f_ingredientes,
    NOT q_confirmados OR cadenas IS NOT NULL AS f_gondola,
    NOT q_registro OR fuente_decision = 'certificacion_oficial' AS f_registro,
    q_estados IS NULL OR ',' || q_estados || ',' LIKE '%,' || estado || ',%' AS f_veredicto
  FROM o_q CROSS JOIN o_p p"""
CHECK_VIEWS["o_score"] = """SELECT *, CASE WHEN len(ts) = 0 THEN 0.0 WHEN n = ' ' || q THEN 10000.0
    WHEN len(list_filter(ts, lambda t: NOT contains(w, ' ' || t))) > 0 THEN 0.0
    ELSE CASE WHEN starts_with(n, ' ' || q) THEN 500 WHEN contains(n, ' ' || q) THEN 250 ELSE 0 END
      + list_sum(list_transform(ts, lambda t: CASE WHEN contains(n, ' ' || t) THEN 60 ELSE 25 END))
      + greatest(0.0, 40.0 - length(nombre) / 4.0) END::DOUBLE AS p FROM o_pair"""
_ALL = "f_categoria AND f_ingredientes AND f_gondola AND f_registro"


@query(
    "search_filters",
    f"""SELECT q_id, ean, lugar FROM (SELECT q_id, ean, row_number() OVER (PARTITION BY q_id ORDER BY nombre, ean)
      AS lugar FROM o_pair WHERE q = '' AND {_ALL} AND f_veredicto) WHERE lugar <= 24""",
)
def search_filters(spark, d):
    return S.filtered_page(products(spark, d), asked(spark, d), S.PAGE_SIZE)


@query("search_code", "SELECT q_id, p.ean, nombre FROM o_q JOIN o_p p ON p.ean = q WHERE codigo")
def search_code(spark, d):
    return S.find_code(products(spark, d), asked(spark, d)).select("q_id", "ean", "nombre")


@query(
    "search_ranked",
    f"""SELECT q_id, ean, nombre, p AS puntaje, lugar FROM (SELECT *, row_number() OVER (PARTITION BY q_id
      ORDER BY p DESC, nombre, ean) AS lugar FROM o_score WHERE NOT codigo AND p > 0 AND {_ALL} AND f_veredicto)
    WHERE lugar <= 20""",
)
def search_ranked(spark, d):
    return S.ranked(products(spark, d), asked(spark, d), 20)


@query(
    "search_like",
    """SELECT q_id, ean, nombre, lugar FROM (SELECT q_id, ean, nombre, row_number() OVER (PARTITION BY q_id
      ORDER BY nombre, ean) AS lugar FROM o_q JOIN v_products ON (translate(nombre, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') LIKE '%' || translate(trim(q_texto), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') || '%' OR lower(marca) LIKE '%' || lower(trim(q_texto)) || '%') AND (q_estados IS NULL OR
      ',' || q_estados || ',' LIKE '%,' || estado || ',%')) WHERE lugar <= 24""",
)
def search_like(spark, d):
    return S.like_search(products(spark, d), asked(spark, d), S.PAGE_SIZE)


@query(
    "completeness_order",
    r"""SELECT ean, nombre, CASE WHEN
      len(regexp_extract_all(nombre, '\p{L}')) >= 3 THEN 1 ELSE 0 END + CASE WHEN ingredients_text <> '' THEN 2
      ELSE 0 END + CASE WHEN imagen_url IS NULL THEN 0 ELSE 1 END + CASE WHEN cadenas IS NULL THEN 0 ELSE 1 END
      AS puntaje FROM v_products""",
)
def completeness_order(spark, d):
    rows = products(spark, d)
    score = S.completeness(
        F.col("nombre"), F.col("ingredients_text"), F.col("imagen_url"), F.col("cadenas")
    )
    return rows.select("ean", "nombre", score.cast("bigint").alias("puntaje")).orderBy(
        F.desc("puntaje"), "nombre", "ean"
    )


@query(
    "search_facets",
    f"""SELECT o_q.q_id, count(*) FILTER (WHERE estado = 'apto') AS apto,
      count(*) FILTER (WHERE estado = 'vegetariano') AS vegetariano,
      count(*) FILTER (WHERE estado = 'no_apto') AS no_apto, count(*) FILTER (WHERE estado = 'revisar') AS revisar
    FROM o_q LEFT JOIN (SELECT q_id, estado FROM o_score WHERE CASE WHEN codigo THEN ean = q
      ELSE {_ALL} AND (q = '' OR p > 0) END) x ON x.q_id = o_q.q_id GROUP BY o_q.q_id""",
)
def search_facets(spark, d):
    return S.facets(products(spark, d), asked(spark, d))


_OUT = {"categoria": "q_categoria IS NOT NULL", "ingredientes": "q_con_ingredientes",
        "gondola": "q_confirmados", "registro": "q_registro", "veredicto": "q_estados IS NOT NULL"}
_ROWS = " UNION ALL ".join(
    f"SELECT q_id, {i} AS orden, '{name}' AS filtro, count(*) FILTER (WHERE ({active}) AND "
    + " AND ".join(f"f_{other}" for other in _OUT if other != name)
    + f") AS n, count(*) FILTER (WHERE {_ALL} AND f_veredicto) AS todos FROM o_score"
    " WHERE NOT codigo AND (q = '' OR p > 0) GROUP BY q_id"
    for i, (name, active) in enumerate(_OUT.items())
)


@query(
    "search_rescue",
    f"""SELECT q_id, filtro, n FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, orden) AS i
      FROM ({_ROWS}) WHERE todos = 0) WHERE i = 1 AND n > 0""",
)
def search_rescue(spark, d):
    return S.rescue(products(spark, d), asked(spark, d))


VIEWS["v_terms"] = """
SELECT CASE event_type WHEN 'view' THEN ' ' || p.base || '  Brand ' || cast(event_id % 30 AS varchar(20))
    WHEN 'click' THEN upper(p.food) WHEN 'error' THEN 'nada ' || p.base WHEN 'signup' THEN 'ab'
    ELSE p.noun || ' ' || p.adj END AS termino, user_id AS sesion
FROM (SELECT *, event_id % (SELECT count(*) FROM part) AS nth FROM events) e JOIN v_part p ON p.p_partkey = nth
"""


@query(
    "zero_result_terms",
    r"""WITH t AS (SELECT DISTINCT substring(trim(regexp_replace(lower(trim(termino)), '\s+', ' ', 'g')), 1, 60)
        AS termino, sesion FROM v_terms),
    c AS (SELECT termino, count(*) AS sesiones, list_filter(string_split(strip_accents(termino), ' '),
        lambda t: t <> '') AS ts FROM t WHERE length(termino) >= 3 GROUP BY termino)
    SELECT termino, sesiones FROM c WHERE NOT EXISTS (SELECT 1 FROM o_p WHERE len(list_filter(c.ts,
      lambda t: NOT contains(o_p.w, ' ' || t))) = 0)""",
)
def zero_result_terms(spark, d):
    return S.zero_result_terms(view(spark, d, "v_terms"), products(spark, d))


# Searched words come from the source names and the first words of the benchmark texts.
VIEWS["v_doc_queries"] = """
SELECT 'b' || cast(item_id AS varchar(20)) AS q_id, split_part(text, ' ', 2) || ' '
  || substring(split_part(text, ' ', 3), 1, 2) AS q_texto FROM benchmark
"""
_WORDS = r"list_filter(string_split(trim(regexp_replace(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '')"




def _fulltext_check(docs, queries, key):
    """First pages of a prefix search over ``docs`` (key, text) by comparing every word of every text."""
    return f"""WITH d AS (SELECT {key}, {_WORDS.format('texto')} AS ws FROM ({docs})),
    s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
    t AS (SELECT DISTINCT q_id, unnest({_WORDS.format('q_texto')}) AS t FROM {queries}),
    u AS (SELECT DISTINCT t FROM t),
    f AS (SELECT {key}, len(ws) AS l, t, len(list_filter(ws, lambda w: starts_with(w, t))) AS tf FROM d, u),
    g AS (SELECT t, count(*) AS df FROM f WHERE tf > 0 GROUP BY t),
    z AS (SELECT t.q_id, {key}, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS p, count(*) AS have FROM f JOIN g ON g.t = f.t
      JOIN t ON t.t = f.t, s WHERE tf > 0 GROUP BY 1, 2),
    r AS (SELECT z.*, row_number() OVER (PARTITION BY z.q_id ORDER BY round(p, 6) DESC, {key}) AS lugar FROM z
      JOIN (SELECT q_id, count(*) AS need FROM t GROUP BY q_id) k ON k.q_id = z.q_id AND have = need)
    SELECT q_id, {key}, floor(p * 1000 + 0.5) / 1000 AS puntaje, lugar FROM r WHERE lugar <= 20"""


def _index(spark, fields, key):
    return P.Index(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", fields, key)


def _shown(hits, key):
    score = (F.floor(F.col("puntaje") * 1000 + 0.5) / 1000).alias("puntaje")
    return hits.select("q_id", F.col("doc").alias(key), score, "lugar")


@query("search_fulltext", _fulltext_check("SELECT doc_id, text AS texto FROM documents", "v_doc_queries", "doc_id"))
def search_fulltext(spark, d):
    docs = sql(spark, d, "SELECT doc_id AS doc, text AS texto FROM documents")
    index = _index(spark, ["texto"], "bigint").build(docs)
    return _shown(index.search(view(spark, d, "v_doc_queries"), 20), "doc_id")


_NAMES = "SELECT ean, nombre || ' ' || coalesce(marca, '') AS texto FROM v_products"


@query("search_names", _fulltext_check(_NAMES, "v_queries", "ean"))
def search_names(spark, d):
    docs = view(spark, d, "v_products").select(F.col("ean").alias("doc"), "nombre", "marca")
    return _shown(_index(spark, ["nombre", "marca"], "string").build(docs).search(asked(spark, d), 20), "ean")


# An index of earlier products, of which the delta renames some, adds some and removes some.
VIEWS["v_earlier"] = """
SELECT ean, CASE WHEN p_partkey % 7 = 0 THEN 'viejo ' || nombre || ' nada' ELSE nombre END AS nombre, marca
FROM v_products WHERE p_partkey % 13 <> 5
"""
VIEWS["v_changed"] = """
SELECT ean, nombre, marca FROM v_products WHERE (p_partkey % 7 = 0 OR p_partkey % 13 = 5) AND p_partkey % 11 <> 3
"""
VIEWS["v_removed"] = "SELECT ean FROM v_products WHERE p_partkey % 11 = 3"


def _after_delta(spark, d):
    def docs(name):
        return view(spark, d, name).withColumnRenamed("ean", "doc")

    return _index(spark, ["nombre", "marca"], "string").build(docs("v_earlier")).apply(docs("v_changed"), docs("v_removed"))


@query("search_after_delta", _fulltext_check(f"{_NAMES} WHERE p_partkey % 11 <> 3", "v_queries", "ean"))
def search_after_delta(spark, d):
    return _shown(_after_delta(spark, d).search(asked(spark, d), 20), "ean")


@query(
    "vocabulary_after_delta",
    f"""SELECT palabra, count(*) AS n FROM (SELECT DISTINCT ean, unnest({_WORDS.format('texto')}) AS palabra
      FROM ({_NAMES} WHERE p_partkey % 11 <> 3)) GROUP BY palabra""",
)
def vocabulary_after_delta(spark, d):
    return _after_delta(spark, d).vocabulary()


# --- model --------------------------------------------------------------------


@query(
    "ml_training_set",
    """SELECT ean, lower(trim(nombre || ' ' || coalesce(marca, ''))) AS texto, estado FROM v_products
      WHERE estado <> 'revisar' AND fuente_decision IN ('certificacion_oficial', 'off_label', 'ingredientes',
      'off_analysis')""",
)
def ml_training_set(spark, d):
    return M.training_set(products(spark, d))


CHECK_VIEWS["o_gram"] = r"""WITH w AS (SELECT ean, regexp_extract_all(strip_accents(lower(nombre || ' ' ||
      coalesce(marca, ''))), '[\p{L}\p{N}_]{2,}') AS ws FROM v_products),
    g AS (SELECT ean, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))
      AS termino FROM w)
  SELECT ean, termino, count(*) AS tf FROM g GROUP BY 1, 2"""


@query(
    "ml_tfidf",
    """WITH d AS (SELECT termino, ln(((SELECT count(*) FROM v_products) + 1.0) / (count(*) + 1)) + 1 AS idf
      FROM o_gram GROUP BY termino HAVING count(*) >= 2),
    w AS (SELECT ean, g.termino, (1 + ln(tf)) * idf AS w FROM o_gram g JOIN d ON d.termino = g.termino)
    SELECT ean, termino, floor(w / sqrt(sum(w * w) OVER (PARTITION BY ean)) * 1e6 + 0.5) / 1e6 AS peso FROM w""",
)
def ml_tfidf(spark, d):
    rows = products(spark, d).select("ean", M.model_text(F.col("nombre"), F.col("marca")).alias("texto"))
    return M.tfidf(rows, "ean", "texto").withColumn(
        "peso", F.floor(F.col("peso") * 1e6 + 0.5) / 1e6
    )


def labelled(spark, d):
    """Order texts as names with their text verdict as label."""
    rows = view(spark, d, "v_label").select("ean", "txt")
    judged = I.analyze_text(rows, "txt", "e")
    return judged.select("ean", F.lower("txt").alias("texto"), F.col("e.estado").alias("estado"))


def _fitted(spark, d):
    rows = reliable(labelled(spark, d))
    parted = M.split(rows.filter("estado <> 'revisar'"), "estado", "ean")
    return M.fit(parted.filter("entrena").drop("entrena")), parted, rows


# The share of a class that trains is a count; which rows train is a matter of a hash.
@query(
    "ml_split",
    """SELECT estado, entrena, CASE WHEN entrena THEN floor(n * 0.75) ELSE n - floor(n * 0.75) END::BIGINT AS n
      FROM (SELECT estado, count(*) AS n FROM o_ev WHERE src = 'text' AND estado <> 'revisar' GROUP BY estado),
      (VALUES (true), (false)) AS s(entrena)""",
)
def ml_split(spark, d):
    rows = reliable(labelled(spark, d))
    parted = M.split(rows.filter("estado <> 'revisar'"), "estado", "ean")
    return parted.groupBy("estado", "entrena").agg(F.count("*").alias("n"))


@query("ml_predictions")
def ml_predictions(spark, d):
    model, parted, _ = _fitted(spark, d)
    scored = M.predict(model, parted.filter("NOT entrena"))
    answer = M.threshold(F.col("clases"), F.col("probas"))
    return scored.select("ean", F.col("estado").alias("real"), answer["estado"].alias("dicho"))


@query("ml_top_terms")
def ml_top_terms(spark, d):
    model, _, _ = _fitted(spark, d)
    return M.top_terms(model, 12)


@query("ml_apply")
def ml_apply(spark, d):
    model, _, rows = _fitted(spark, d)
    table = rows.select(
        "ean", F.col("texto").alias("nombre"), F.lit(None).cast("string").alias("marca"), "estado",
        F.lit("ingredientes").alias("fuente_decision"), F.lit(None).cast("double").alias("confianza"),
        F.lit("").alias("motivo"),
    )
    done = M.apply(model, table)
    return done.groupBy("estado", "fuente_decision").agg(F.count("*").alias("n"))


# A probability table drawn from the keys, so that every threshold case occurs.
VIEWS["v_probas"] = """
SELECT ean, estado, cast(p_partkey * 7 % 101 AS double) / 101 AS pa,
  cast(p_partkey * 7 % 101 AS double) / 101 + cast((101 - p_partkey * 7 % 101) * (p_partkey * 13 % 97) AS double) / 9797 AS pb
FROM v_products
"""
_ARG = """CASE WHEN pa >= pb - pa AND pa >= 1 - pb THEN 'apto' WHEN pb - pa >= 1 - pb THEN 'no_apto'
  ELSE 'vegetariano' END"""


def _probabilities(spark, d):
    rows = view(spark, d, "v_probas")
    names = F.array(F.lit("apto"), F.lit("no_apto"), F.lit("vegetariano"))
    values = F.array(F.col("pa"), F.col("pb") - F.col("pa"), 1 - F.col("pb"))
    return rows.select("ean", "estado", M.threshold(names, values).alias("t"), values.alias("v"), names.alias("c"))


CHECK_VIEWS["o_thr"] = f"""SELECT ean, estado, {_ARG} AS clase, greatest(pa, pb - pa, 1 - pb) AS p FROM v_probas"""


@query(
    "ml_threshold",
    """SELECT ean, CASE WHEN p < CASE clase WHEN 'apto' THEN 0.85 ELSE 0.65 END THEN 'revisar' ELSE clase END
      AS estado, floor(p * 10000 + 0.5) / 10000 AS p FROM o_thr""",
)
def ml_threshold(spark, d):
    return _probabilities(spark, d).select(
        "ean", "t.estado", (F.floor(F.col("t.p") * 10000 + 0.5) / 10000).alias("p")
    )


def _predictions(spark, d):
    return _probabilities(spark, d).select("estado", F.col("t.estado").alias("predicho"))


CHECK_VIEWS["o_pred"] = """SELECT estado, CASE WHEN p < CASE clase WHEN 'apto' THEN 0.85 ELSE 0.65 END THEN 'revisar'
  ELSE clase END AS predicho FROM o_thr"""


@query("ml_confusion", "SELECT estado, predicho, count(*) AS n FROM o_pred GROUP BY 1, 2")
def ml_confusion(spark, d):
    return M.confusion(_predictions(spark, d))


@query(
    "ml_metrics",
    """WITH c AS (SELECT DISTINCT estado AS c FROM o_pred UNION SELECT predicho FROM o_pred),
    m AS (SELECT c, (SELECT count(*) FROM o_pred WHERE estado = c) AS s, (SELECT count(*) FROM o_pred
      WHERE predicho = c) AS q, (SELECT count(*) FROM o_pred WHERE predicho = c AND estado = c) AS b FROM c),
    r AS (SELECT c, s, CASE WHEN q = 0 THEN 0 ELSE b / q END AS p, CASE WHEN s = 0 THEN 0 ELSE b / s END AS r FROM m),
    f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM r),
    a AS (SELECT c AS clase, p AS precision, r AS recall, f AS f1, s AS soporte FROM f
      UNION ALL SELECT 'accuracy', x, x, x, n FROM (SELECT sum(b) / sum(s) AS x, sum(s)::BIGINT AS n FROM m)
      UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s)::BIGINT FROM f)
    SELECT clase, floor(precision * 1e6 + 0.5) / 1e6 AS precision, floor(recall * 1e6 + 0.5) / 1e6 AS recall,
      floor(f1 * 1e6 + 0.5) / 1e6 AS f1, soporte FROM a""",
)
def ml_metrics(spark, d):
    rows = M.metrics(_predictions(spark, d))

    def cut(name):
        return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)

    return rows.select("clase", cut("precision"), cut("recall"), cut("f1"), "soporte")
