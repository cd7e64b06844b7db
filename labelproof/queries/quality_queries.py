"""Filters, queues, coverage of loads and listings."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelproof.bindings.views import VIEWS, sql, view
from labelproof.operators import candidates as J
from labelproof.operators import coverage as A
from labelproof.operators import listing as L
from labelproof.operators import quality as Q
from labelproof.operators import review as W
from labelproof.queries.base import CHECK_VIEWS, query
from labelproof.queries.source_queries import products, shelf_table
from labelproof.rules import rows
from labelproof.rules.labels import CHAIN_LABELS, SOURCE_LABELS, STATE_LABELS

DEMO_WORDS = {"word_list": ["lecitina"], "phrases": ["leche y sal"]}


@query("filter_script", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[äöüß]')")
def filter_script(spark, d):
    docs = sql(spark, d, "SELECT doc_id, lang, text FROM documents")
    return docs.filter(Q.other_script(F.col("text"), "[äöüß]")).select("doc_id", "lang")


@query("filter_code_length", "SELECT o, k, codigo FROM v_codes WHERE length(codigo) IN (8, 12, 13, 14)")
def filter_code_length(spark, d):
    return view(spark, d, "v_codes").filter(~Q.bad_length(F.col("codigo"))).select("o", "k", "codigo")


@query(
    "filter_wordlist",
    r"""SELECT ean, nombre FROM v_catalog WHERE regexp_matches(lower(nombre), '\blecitina\b')
      OR contains(lower(nombre), 'leche y sal')""",
)
def filter_wordlist(spark, d):
    names = view(spark, d, "v_catalog")
    return names.filter(Q.is_non_food(F.col("nombre"), **DEMO_WORDS)).select("ean", "nombre")


_CODED = """SELECT CASE WHEN p_partkey % 17 = 0 THEN substring(ean, 1, 9) ELSE ean END AS ean, nombre
  FROM v_catalog"""
CHECK_VIEWS["o_excl"] = f"""SELECT ean, nombre, CASE WHEN nombre LIKE '%Ú%' THEN 'alfabeto'
    WHEN length(ean) = 9 THEN 'ean_invalido' WHEN lower(nombre) LIKE '%lecitina%'
      OR lower(nombre) LIKE '%leche y sal%' THEN 'no_alimento' END AS clase FROM ({_CODED})"""


def _reasons(spark, d):
    coded = sql(spark, d, _CODED)
    reason = Q.exclusion_reason(F.col("nombre"), F.col("ean"), script="[Ú]", **DEMO_WORDS)
    return coded.withColumn("motivo", reason)


@query(
    "exclusion_reason",
    """SELECT ean, nombre, CASE clase WHEN 'alfabeto' THEN 'nombre en un alfabeto que no se usa en el '
      || 'comercio argentino (posible país mal etiquetado en origen)' WHEN 'ean_invalido' THEN
      'el código ''' || ean || ''' no tiene una longitud de EAN/UPC real' WHEN 'no_alimento' THEN
      'el nombre corresponde a un producto que no es un alimento' END AS motivo FROM o_excl""",
)
def exclusion_reason(spark, d):
    return _reasons(spark, d)


@query(
    "exclusion_counts",
    "SELECT clase, count(*) AS n FROM o_excl WHERE clase IS NOT NULL GROUP BY clase",
)
def exclusion_counts(spark, d):
    classed = _reasons(spark, d).select(Q.exclusion_class(F.col("motivo")).alias("clase"))
    return classed.filter("clase IS NOT NULL").groupBy("clase").agg(F.count("*").alias("n"))


@query(
    "purge_phantoms",
    """SELECT p.ean, p.fuente_decision FROM v_products p LEFT JOIN v_payload c ON c.ean = p.ean
      AND c.found WHERE coalesce(off_categories, '') <> '' OR coalesce(trim(ingredients_text), '') <> ''
      OR cadenas IS NOT NULL OR fuente_decision NOT IN ('heuristica', 'ml', 'sin_datos')""",
)
def purge_phantoms(spark, d):
    found = view(spark, d, "v_payload").filter("found").select(
        "ean", F.filter(F.split("off_categories", ","), lambda t: t != "").alias("tags")
    )
    df = products(spark, d).join(found, "ean", "left")
    phantom = Q.is_phantom(
        F.col("tags"), F.col("ingredients_text"), F.col("cadenas"), F.col("fuente_decision")
    )
    return df.filter(~phantom).select("ean", "fuente_decision")


def _cache(spark, d):
    events = sql(
        spark, d, "SELECT user_id, event_type, CAST(ts AS timestamp) AS ts FROM events"
    )
    last = events.groupBy("user_id").agg(F.max("ts").alias("consultado"))
    now = events.agg(F.max("ts").alias("t")).scalar()
    return last, Q.cache_is_fresh(F.col("consultado"), now, 1)


_FRESH = """SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS fresca FROM events
  GROUP BY user_id"""


@query("cache_fresh", _FRESH)
def cache_fresh(spark, d):
    last, fresh = _cache(spark, d)
    return last.select("user_id", fresh.alias("fresca"))


@query(
    "cache_pending",
    f"""SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM ({_FRESH})
      WHERE fresca)""",
)
def cache_pending(spark, d):
    last, fresh = _cache(spark, d)
    wanted = sql(spark, d, "SELECT c_custkey AS user_id FROM customer")
    return Q.pending_keys(wanted, last, "user_id", fresh)


_OUTCOME = """CASE WHEN status = 503 THEN 'no_contesto' WHEN status = 404 THEN 'no_la_tiene'
    WHEN NOT json_ok THEN 'no_contesto' WHEN NOT hallado THEN 'no_la_tiene' ELSE 'respondio' END"""


def _outcomes(spark, d):
    outcome = Q.fetch_outcome(F.col("status"), F.col("json_ok"), F.col("hallado"))
    return view(spark, d, "v_log").withColumn("resultado", outcome)


@query("fetch_outcome", f"SELECT pos, dia, {_OUTCOME} AS resultado FROM v_log")
def fetch_outcome(spark, d):
    return _outcomes(spark, d).select("pos", "dia", "resultado")


@query(
    "failure_streak_cut",
    f"""WITH e AS (SELECT pos, dia, {_OUTCOME} AS resultado FROM v_log),
    i AS (SELECT *, sum(CASE WHEN resultado = 'no_contesto' THEN 0 ELSE 1 END) OVER (PARTITION BY dia
      ORDER BY pos) AS isla FROM e),
    r AS (SELECT *, sum(CASE WHEN resultado = 'no_contesto' THEN 1 ELSE 0 END) OVER (PARTITION BY dia, isla
      ORDER BY pos) AS racha FROM i),
    c AS (SELECT dia, min(pos) AS corte FROM r WHERE racha >= 4 GROUP BY dia)
    SELECT e.pos, e.dia, resultado FROM e LEFT JOIN c ON c.dia = e.dia
    WHERE (corte IS NULL OR pos <= corte) AND resultado <> 'no_contesto'""",
)
def failure_streak_cut(spark, d):
    log = _outcomes(spark, d)
    failed = F.col("resultado") == "no_contesto"
    kept = Q.cut_failure_streak(log, "dia", "pos", failed, streak=4, chunk=500)
    return kept.filter("resultado <> 'no_contesto'").select("pos", "dia", "resultado")


@query(
    "branch_filter",
    "SELECT id, nombre FROM v_tree WHERE regexp_matches(strip_accents(lower(nombre)), 'bebida|lacteo|almacen')",
)
def branch_filter(spark, d):
    return view(spark, d, "v_tree").filter(Q.is_food_branch(F.col("nombre"))).select("id", "nombre")


@query(
    "hierarchy_drilldown",
    r"""WITH RECURSIVE cap AS (SELECT count(*) / 20.0 AS c FROM customer),
    w AS (SELECT id, total, hoja FROM v_tree WHERE parent IS NULL
        AND regexp_matches(strip_accents(lower(nombre)), 'bebida|lacteo|almacen')
      UNION ALL SELECT t.id, t.total, t.hoja FROM v_tree t JOIN w ON t.parent = w.id
        WHERE w.total > (SELECT c FROM cap) AND NOT w.hoja)
    SELECT id, least(total, floor((SELECT c FROM cap)))::BIGINT AS total FROM w
    WHERE total > 0 AND (total <= (SELECT c FROM cap) OR hoja)""",
)
def hierarchy_drilldown(spark, d):
    tree = view(spark, d, "v_tree")
    root = F.col("parent").isNull() & Q.is_food_branch(F.col("nombre"))
    nodes = tree.select("id", "parent", "total", F.col("hoja").alias("leaf"), root.alias("raiz"))
    cap = sql(spark, d, "SELECT CAST(floor(count(*) / 20.0) AS bigint) AS c FROM customer").scalar()
    return L.drill_down(nodes, cap)


# --- queues, samples and listings ---------------------------------------------

_WEIGHT = "count(*) OVER (PARTITION BY coalesce(marca, ''))"


@query(
    "review_queue",
    f"SELECT ean, nombre, marca, {_WEIGHT} AS peso FROM v_products WHERE estado = 'revisar'",
)
def review_queue(spark, d):
    return W.queue(products(spark, d)).select("ean", "nombre", "marca", "peso")


@query(
    "risk_queue",
    f"""SELECT ean, nombre, marca, {_WEIGHT} AS peso FROM v_products WHERE estado = 'apto'
      AND fuente_decision IN ('heuristica', 'ml')""",
)
def risk_queue(spark, d):
    return W.queue(products(spark, d), risk=True).select("ean", "nombre", "marca", "peso")


@query(
    "sink_review_csv",
    """SELECT ean, nombre, coalesce(marca, '') AS marca, coalesce(categoria, '') AS categoria, estado AS estado_actual,
      coalesce(motivo, '') AS motivo_actual, substring(coalesce(ingredients_text, ''), 1, 300) AS ingredientes,
      '' AS estado_corregido, '' AS revisor FROM v_products WHERE estado = 'revisar'""",
)
def sink_review_csv(spark, d):
    from labelproof.sinks.tables import review_rows

    return review_rows(W.queue(products(spark, d)))


@query("seeded_sample")
def seeded_sample(spark, d):
    return W.seeded_sample(products(spark, d), F.col("ean"), 500).select("ean", "nombre", "estado")


@query(
    "paged_listing",
    """SELECT ean, nombre, (i // 24 + 1)::BIGINT AS pagina, (i % 24 + 1)::BIGINT AS lugar FROM (
      SELECT ean, nombre, row_number() OVER (ORDER BY nombre, ean) - 1 AS i FROM v_products)""",
)
def paged_listing(spark, d):
    rows_ = products(spark, d).select("ean", "nombre")
    return L.pages(rows_, [F.col("nombre"), F.col("ean")], 24)


@query(
    "page_of_listing",
    """SELECT ean, nombre, i::BIGINT AS lugar FROM (SELECT ean, nombre, row_number() OVER (ORDER BY nombre, ean) AS i,
      greatest(1, ceil(count(*) OVER () / 24.0)) AS n FROM v_products) WHERE ceil(i / 24.0) IN (1, n // 2, n)""",
)
def page_of_listing(spark, d):
    """The first, the middle and the last page of a kept listing, with the place of each row."""
    rows_ = products(spark, d).select("ean", "nombre")
    kept = L.PageDirectory(rows_, [F.col("nombre"), F.col("ean")], 24)
    last = kept.page_count()
    pages = [kept.page(n).select("*", F.lit((n - 1) * 24).alias("_antes")) for n in sorted({1, max(1, last // 2), last})]
    both = functools.reduce(DataFrame.unionByName, pages)
    place = F.row_number().over(Window.partitionBy("_antes").orderBy("nombre", "ean"))
    return both.select("ean", "nombre", (F.col("_antes") + place).cast("bigint").alias("lugar"))


@query(
    "page_counts",
    """SELECT estado, count(*) AS n, greatest(1, ceil(count(*) / 24.0))::BIGINT AS paginas FROM v_products
      GROUP BY estado""",
)
def page_counts(spark, d):
    counted = products(spark, d).groupBy("estado").agg(F.count("*").alias("n"))
    return counted.withColumn("paginas", L.page_count(F.col("n"), 24))


@query(
    "category_index",
    "SELECT categoria, count(*) AS n FROM v_products WHERE categoria IS NOT NULL GROUP BY categoria",
)
def category_index(spark, d):
    return L.category_index(products(spark, d), "categoria")


@query(
    "neighbours",
    """WITH n AS (SELECT ean, categoria, nombre, row_number() OVER (PARTITION BY categoria
      ORDER BY nombre, ean) AS i FROM v_products WHERE categoria IS NOT NULL)
    SELECT a.ean, b.ean AS vecino, row_number() OVER (PARTITION BY a.ean ORDER BY b.i) AS orden
    FROM n a JOIN n b ON a.categoria = b.categoria AND abs(a.i - b.i) <= 3 AND a.i <> b.i""",
)
def neighbours(spark, d):
    named = products(spark, d).filter("categoria IS NOT NULL")
    return L.neighbours(named, "categoria", ["nombre"], "ean", chunk=700)


@query(
    "label_lookup",
    """SELECT ean, CASE estado WHEN 'apto' THEN 'Apto vegano' WHEN 'vegetariano' THEN
        'Vegetariano (no vegano)' WHEN 'no_apto' THEN 'No apto' ELSE 'A revisar' END AS etiqueta,
      coalesce(s.t, fuente_decision) AS fuente,
      coalesce(replace(replace(replace(replace(replace(cadenas, 'carrefour', 'Carrefour'), 'vea', 'Vea'),
        'dia', 'Día'), 'jumbo', 'Jumbo'), 'disco', 'Disco'), '') AS cadenas
    FROM v_products LEFT JOIN (VALUES
      ('certificacion_oficial', 'Certificado en el registro oficial de ANMAT'),
      ('off_label', 'Declarado vegano por el fabricante'),
      ('sello_super', 'Sello de certificación en la ficha del supermercado'),
      ('ingredientes', 'Analizado desde la lista de ingredientes'),
      ('ingredientes_super', 'Analizado desde los ingredientes que publica el supermercado'),
      ('off_analysis', 'Análisis de ingredientes de Open Food Facts'),
      ('heuristica', 'Estimado por reglas sobre el nombre del producto'),
      ('ml', 'Estimado por clasificador automático'), ('sin_datos', 'Sin datos suficientes')) s(f, t)
      ON s.f = fuente_decision""",
)
def label_lookup(spark, d):
    from labelproof.functions.patterns import lookup

    states, sources, chains = rows(STATE_LABELS, 2), rows(SOURCE_LABELS, 2), rows(CHAIN_LABELS, 2)
    named = F.transform("cadenas", lambda c: F.coalesce(lookup(chains, c), c))
    return products(spark, d).select(
        "ean",
        F.coalesce(lookup(states, F.col("estado")), F.lit("A revisar")).alias("etiqueta"),
        F.coalesce(lookup(sources, F.col("fuente_decision")), F.col("fuente_decision")).alias("fuente"),
        F.coalesce(F.array_join(named, ","), F.lit("")).alias("cadenas"),
    )


@query(
    "load_gap",
    """SELECT c_mktsegment, greatest(0, n + 7 - vistos) AS faltan FROM (SELECT c_mktsegment, count(*) AS n,
      count(DISTINCT o_custkey) AS vistos FROM customer LEFT JOIN orders ON o_custkey = c_custkey
      GROUP BY c_mktsegment)""",
)
def load_gap(spark, d):
    counted = sql(
        spark, d,
        "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS vistos FROM customer"
        " LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    )
    return counted.select("c_mktsegment", A.load_gap(F.col("n") + 7, F.col("vistos")).alias("faltan"))


@query(
    "source_group_share",
    """SELECT g.orden, g.grupo, count(p.ean) AS n, replace(printf('%.1f%%', floor(100.0 * count(p.ean) /
        (SELECT count(*) FROM v_products) * 10 + 0.5) / 10), '.', ',') AS parte
    FROM (VALUES (0, 'Alguien lo certificó'), (1, 'Leímos la lista de ingredientes'),
      (2, 'Es el mismo producto que otro'), (3, 'Lo estimamos por el nombre'), (4, 'No sabemos')) g(orden, grupo)
    LEFT JOIN v_products p ON g.orden = CASE
      WHEN fuente_decision IN ('certificacion_oficial', 'off_label', 'sello_super') THEN 0
      WHEN fuente_decision IN ('ingredientes', 'ingredientes_super', 'off_analysis') THEN 1
      WHEN fuente_decision = 'duplicado' THEN 2 WHEN fuente_decision IN ('heuristica', 'ml') THEN 3
      ELSE 4 END GROUP BY 1, 2""",
)
def source_group_share(spark, d):
    return A.source_groups(products(spark, d), "fuente_decision")


@query(
    "counts_by",
    """SELECT 'categoria' AS tipo, categoria AS valor, count(*) AS n FROM v_products
      WHERE categoria IS NOT NULL GROUP BY categoria
    UNION ALL SELECT 'estado', estado, count(*) FROM v_products GROUP BY estado
    UNION ALL SELECT 'fuente', fuente_decision, count(*) FROM v_products GROUP BY fuente_decision""",
)
def counts_by(spark, d):
    kinds = {"estado": "estado", "fuente": "fuente_decision", "categoria": "categoria"}
    return A.counts_by(products(spark, d), {k: F.col(c) for k, c in kinds.items()})


# --- candidates ---------------------------------------------------------------

CHECK_VIEWS["o_universe"] = """SELECT c.ean, nombre, marca, precio_ref, off_txt FROM v_listed c
    LEFT JOIN v_payload p ON p.ean = c.ean AND found
  UNION ALL SELECT v.ean, v.nombre, v.marca, v.precio, NULL FROM v_sheet f JOIN o_shelf v ON v.ean = f.ean
    AND v.cadena = f.cadena LEFT JOIN v_listed c ON c.ean = f.ean WHERE c.ean IS NULL
    AND (coalesce(f.ingredientes, '') <> '' OR ',' || coalesce(f.sellos, '') || ',' LIKE '%,vegan,%')"""


@query(
    "join_left_payload",
    """SELECT c.ean, nombre, off_txt AS texto FROM v_catalog c LEFT JOIN v_payload p ON p.ean = c.ean AND found""",
)
def join_left_payload(spark, d):
    from labelproof.sources.readers import parse_payload

    joined = J.with_payload(view(spark, d, "v_catalog"), view(spark, d, "v_cache"))
    return parse_payload(joined).select("ean", "nombre", F.col("payload.ingredients_text").alias("texto"))


def build_inputs(spark, d):
    """Catalog, cache, reduced shelf and sheets of the build."""
    sheets = view(spark, d, "v_sheet").drop("o")
    return view(spark, d, "v_listed"), view(spark, d, "v_cache"), shelf_table(spark, d), sheets


@query("candidate_universe", "SELECT ean, nombre, marca, precio_ref, off_txt AS texto FROM o_universe")
def candidate_universe(spark, d):
    from labelproof.sources.readers import parse_payload

    rows_ = parse_payload(J.universe(*build_inputs(spark, d)))
    return rows_.select(
        "ean", "nombre", "marca", "precio_ref", F.col("payload.ingredients_text").alias("texto")
    )


@query(
    "first_by_priority",
    """WITH r AS (SELECT *, CASE cadena WHEN 'carrefour' THEN 0 WHEN 'vea' THEN 1 WHEN 'dia' THEN 2
      WHEN 'jumbo' THEN 3 ELSE 4 END AS q FROM o_shelf)
    SELECT ean, arg_min(trim(marca), q) FILTER (WHERE trim(marca) <> '') AS marca_gondola,
      arg_min(categoria, q) FILTER (WHERE trim(categoria) IN ('Lácteos', 'Congelados', 'Panadería')) AS gondola
    FROM r GROUP BY ean""",
)
def first_by_priority(spark, d):
    return J.shelf_features(shelf_table(spark, d))


@query(
    "harvest_queue",
    """WITH q AS (SELECT v.ean, min(v.cadena) AS cadena, min(v.nombre) AS nombre,
        min(CASE WHEN v.ean LIKE '2%' THEN 3 WHEN p.ean IS NULL THEN 1 WHEN coalesce(p.ingredients_text, '') = ''
          OR p.fuente_decision IN ('heuristica', 'ml', 'sin_datos') THEN 0 ELSE 2 END) AS prioridad
      FROM o_shelf v LEFT JOIN v_fetched f ON f.ean = v.ean LEFT JOIN (SELECT CASE WHEN p_partkey % 5 = 0
        THEN '9' || substring(ean, 2) ELSE ean END AS ean, ingredients_text, fuente_decision FROM v_products) p
        ON p.ean = v.ean
      WHERE v.cadena IN ('disco', 'jumbo', 'vea') AND f.ean IS NULL GROUP BY v.ean)
    SELECT ean, cadena, nombre, prioridad FROM q WHERE lower(nombre) NOT LIKE '%lecitina%'
      AND lower(nombre) NOT LIKE '%leche y sal%'""",
)
def harvest_queue(spark, d):
    known = products(spark, d).withColumn(
        "ean",
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("9"), F.substr("ean", F.lit(2)))).otherwise(F.col("ean")),
    )
    return J.harvest_queue(shelf_table(spark, d), view(spark, d, "v_fetched"), known, **DEMO_WORDS)


@query(
    "chain_confirm",
    """SELECT c.ean, k.cadenas FROM v_catalog c LEFT JOIN (SELECT ean, string_agg(DISTINCT cadena, ','
      ORDER BY cadena) AS cadenas FROM v_shelf_raw GROUP BY ean) k ON k.ean = c.ean""",
)
def chain_confirm(spark, d):
    from labelproof.operators.reconcile import confirm_chains

    rows_ = confirm_chains(view(spark, d, "v_catalog"), view(spark, d, "v_shelf_raw"))
    return rows_.select("ean", F.array_join("cadenas", ",").alias("cadenas"))
