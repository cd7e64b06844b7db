"""Decision, reconciliation, build and coverage queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelproof.bindings.views import VIEWS, view
from labelproof.operators import coverage as A
from labelproof.operators import names as N
from labelproof.operators import reconcile as D
from labelproof.operators import registry as G
from labelproof.operators import verdict as V
from labelproof.operators.duplicate_groups import DuplicateGroups
from labelproof.operators.skew import shared_folder
from labelproof.plans import build as P
from labelproof.queries.base import CHECK_VIEWS, query
from labelproof.queries.evidence_queries import payload_rows
from labelproof.queries.quality_queries import build_inputs
from labelproof.queries.source_queries import products

CHECK_VIEWS["o_analysis"] = """SELECT o, ean, off_analysis, CASE WHEN NOT found THEN 'revisar'
    WHEN off_labels LIKE '%en:vegan' THEN 'apto'
    ELSE CASE off_analysis WHEN 'en:non-vegan' THEN 'no_apto' WHEN 'en:vegan' THEN 'apto'
      WHEN 'en:non-vegan,en:vegetarian' THEN 'vegetariano' WHEN 'en:vegetarian' THEN 'vegetariano'
      WHEN 'en:non-vegetarian' THEN 'no_apto' ELSE 'revisar' END END AS estado,
  CASE WHEN NOT found THEN 'sin_datos' WHEN off_labels LIKE '%en:vegan' THEN 'off_label'
    WHEN off_analysis IN ('', 'en:vegan-status-unknown') THEN 'sin_datos' ELSE 'off_analysis' END AS fuente,
  CASE WHEN NOT found THEN 'El producto no está en Open Food Facts'
    WHEN off_labels LIKE '%en:vegan' THEN 'Declarado vegano por el fabricante'
    ELSE CASE off_analysis WHEN 'en:non-vegan' THEN 'Análisis de ingredientes (Open Food Facts): no vegano'
      WHEN 'en:vegan' THEN 'Confirmado por análisis de ingredientes (Open Food Facts)'
      WHEN 'en:non-vegan,en:vegetarian' THEN 'Análisis de ingredientes: vegetariano, no vegano'
      WHEN 'en:vegetarian' THEN 'Análisis de ingredientes: vegetariano'
      WHEN 'en:non-vegetarian' THEN 'Análisis de ingredientes: contiene ingredientes animales'
      ELSE 'Open Food Facts no pudo determinar el estado' END END AS motivo FROM v_payload"""


@query("analysis_decision", "SELECT o, estado, fuente, motivo FROM o_analysis")
def analysis_decision(spark, d):
    rows = payload_rows(spark, d)
    answer = V.analysis_decision(F.col("off_labels"), F.col("off_analysis"), F.col("found"))
    return rows.select("o", answer.alias("a")).select("o", "a.*")


# Names of one or more foods, so that every step of the name rules occurs.
_NAMES = r"""SELECT o, txt AS nombre, CASE o % 4 WHEN 0 THEN 'Legumbres secas' WHEN 1 THEN 'Quesos duros'
    WHEN 2 THEN 'Almacén' ELSE NULL END AS rubro,
  trim(regexp_replace(replace(strip_accents(lower(txt)), '-', ' '), '\s+', ' ', 'g')) AS t FROM v_label"""
CHECK_VIEWS["o_name"] = _NAMES
CHECK_VIEWS["o_name_word"] = r"""SELECT o, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (
    SELECT o, string_split(t, ' ') AS w FROM o_name)"""
# A keyword is a whole word here; the window is the three words that follow.
CHECK_VIEWS["o_name_hit"] = r"""SELECT a.o, a.i, k.kw, k.r, k.r * 100000 + a.i AS orden,
    min(m.r) AS mod
  FROM o_name_word a JOIN (VALUES ('leche', 10), ('miel', 19), ('gelatina', 20)) k(kw, r)
    ON regexp_extract(a.w, '^\W*(\w+)\W*$', 1) = k.kw
  LEFT JOIN o_name_word b ON b.o = a.o AND b.i > a.i AND b.i <= a.i + CASE WHEN regexp_matches(a.w, '\W$')
      THEN 2 ELSE 3 END
  LEFT JOIN (VALUES ('coco', 0), ('girasol', 10)) m(w, r) ON regexp_extract(b.w, '^\W*(\w+)\W*$', 1) = m.w
  GROUP BY 1, 2, 3, 4"""
CHECK_VIEWS["o_name_best"] = """SELECT o, arg_min(kw, orden) FILTER (WHERE mod IS NULL) AS abierta,
    arg_min(kw, orden) AS neutra, arg_min(coalesce(mod, -1), orden) AS mod FROM o_name_hit GROUP BY o"""
CHECK_VIEWS["o_name_dec"] = r"""SELECT n.o,
  CASE WHEN abierta IS NOT NULL AND rubro = 'Legumbres secas' THEN 'revisar'
    WHEN abierta IS NOT NULL THEN 'no_apto' WHEN neutra IS NOT NULL THEN 'apto'
    WHEN regexp_matches(base, '\b(coco|girasol)\b') THEN 'apto'
    WHEN regexp_matches(t, '^(harina|azucar|aceite)( |$)') THEN 'apto'
    WHEN rubro = 'Quesos duros' THEN 'no_apto' WHEN rubro = 'Legumbres secas' THEN 'apto'
    ELSE 'revisar' END AS estado,
  CASE WHEN abierta IS NOT NULL AND rubro = 'Legumbres secas' THEN
      '"' || abierta || '" en el nombre contradice el rubro "Legumbres secas"'
    WHEN abierta IS NOT NULL THEN '"' || abierta || '" es de origen animal'
    WHEN neutra IS NOT NULL THEN '"' || neutra || ' de ' || CASE mod WHEN 0 THEN 'coco' ELSE 'girasol' END
      || '": versión vegetal'
    WHEN regexp_matches(base, '\b(coco|girasol)\b') THEN 'Base vegetal declarada: "' || base || '"'
    WHEN regexp_matches(t, '^(harina|azucar|aceite)( |$)') THEN '"' || CASE WHEN t LIKE 'aceite de girasol%'
      THEN 'aceite de girasol' ELSE regexp_extract(t, '^[a-z]+') END || '" es de origen vegetal o mineral'
    WHEN rubro = 'Quesos duros' THEN 'Rubro de origen animal: Quesos duros'
    WHEN rubro = 'Legumbres secas' THEN 'Rubro de origen vegetal: Legumbres secas'
    ELSE 'Sin datos suficientes para clasificar por nombre' END AS motivo
  FROM (SELECT *, regexp_extract(t, '\bde\s+([a-z]+(?: de [a-z]+)?)', 1) AS base FROM o_name) n
  LEFT JOIN o_name_best b ON b.o = n.o"""


@query("name_heuristic", "SELECT * FROM o_name_dec")
def name_heuristic(spark, d):
    rows = view(spark, d, "v_label").select(
        "o", F.col("txt").alias("nombre"), F.lit(None).cast("string").alias("marca"),
        F.when(F.col("o") % 4 == 0, "Legumbres secas").when(F.col("o") % 4 == 1, "Quesos duros")
        .when(F.col("o") % 4 == 2, "Almacén").alias("rubro"),
    )
    df = N.name_heuristic(rows, "nombre", "marca", "rubro", "r")
    return df.select("o", "r.estado", "r.motivo")


# Product names with their tokens of weight, and the registry the same way.
_MATCH_NAMES = """SELECT ean, CASE WHEN p_partkey % 2 = 1 THEN nombre || ' ' || adj ELSE nombre END AS nombre,
  CASE WHEN marca IS NULL THEN NULL WHEN p_size % 3 = 0 THEN 'Otra, ' || marca ELSE marca END AS marca
  FROM v_catalog"""
_TOKENS = r"list_distinct(list_filter(regexp_extract_all(strip_accents(lower({0})), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('sabor', 'producto', 'del', 'los', 'las', 'con', 'sin', 'para', 'por', 'una')))"


def _match_views(prefix: str, names: str, registry: str) -> str:
    """Check views of the registry match over a name query and a registry."""
    CHECK_VIEWS[f"o_{prefix}n"] = f"""SELECT ean, generate_subscripts(m, 1) AS lugar, trim(regexp_replace(
        regexp_replace(strip_accents(lower(unnest(m))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS marca, t
      FROM (SELECT ean, string_split(marca, ',') AS m, {_TOKENS.format('nombre')} AS t FROM ({names}))"""
    CHECK_VIEWS[f"o_{prefix}r"] = f"""SELECT id, rnpa, lower(marca) AS marca, {_TOKENS.format('producto')} AS t,
        ['dulce', regexp_extract(producto, 'sabor dulce de (\\w+)', 1)] AS sabor FROM {registry}"""
    CHECK_VIEWS[f"o_{prefix}m"] = f"""SELECT ean, id, rnpa, round_even(s, 2) AS score FROM (SELECT n.ean,
        r.id, r.rnpa, len(list_intersect(n.t, r.t)) / least(len(n.t), len(r.t))::DOUBLE AS s, row_number() OVER (
        PARTITION BY ean ORDER BY len(list_intersect(n.t, r.t)) / least(len(n.t), len(r.t))::DOUBLE DESC, lugar, id)
        AS i FROM o_{prefix}n n JOIN o_{prefix}r r ON r.marca = n.marca AND n.marca <> '' WHERE len(n.t) > 0
        AND len(list_filter(list_intersect(n.t, r.t), lambda x: NOT list_contains(r.sabor, x))) > 0) WHERE i = 1
        AND s >= 0.6"""
    return f"o_{prefix}m"


@query("registry_match", f"SELECT * FROM {_match_views('match_', _MATCH_NAMES, 'v_registry')}")
def registry_match(spark, d):
    rows = view(spark, d, "v_catalog")
    odd = F.col("p_partkey") % 2 == 1
    rows = rows.select(
        "ean",
        F.when(odd, F.concat("nombre", F.lit(" "), "adj")).otherwise(F.col("nombre")).alias("nombre"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Otra, "), "marca"))
        .otherwise(F.col("marca")).alias("marca"),
    )
    return G.match(rows, G.prepare(view(spark, d, "v_registry"), "marca", "producto"))


_KEY = r"trim(regexp_replace(replace(strip_accents(lower(coalesce({0}, ''))), '-', ' '), '\s+', ' ', 'g'))"
_SEV = "CASE {0} WHEN 'no_apto' THEN 2 WHEN 'vegetariano' THEN 1 WHEN 'apto' THEN 0 END"


def _dup_views(prefix: str, source: str) -> str:
    """Check views of the duplicate rule over a product query."""
    CHECK_VIEWS[f"o_{prefix}g"] = f"""SELECT *, count(*) OVER w AS n, max(v) OVER w AS peor FROM (SELECT *,
        {_KEY.format('marca')} || '/' || {_KEY.format('nombre')} AS g, CASE WHEN fuente_decision <> 'sin_datos' THEN
        {_SEV.format('estado')} END AS v FROM {source}) WINDOW w AS (PARTITION BY g)"""
    CHECK_VIEWS[f"o_{prefix}w"] = f"""SELECT *, min(CASE WHEN v = peor THEN ean END) OVER (PARTITION BY g)
        AS peor_ean FROM o_{prefix}g"""
    CHECK_VIEWS[f"o_{prefix}d"] = f"""SELECT * EXCLUDE (estado, fuente_decision, motivo, confianza, n, peor, g, v,
          peor_ean, baja),
        CASE WHEN baja THEN p ELSE estado END AS estado, CASE WHEN baja THEN 'duplicado' ELSE fuente_decision END
        AS fuente_decision, CASE WHEN baja THEN NULL ELSE confianza END AS confianza, CASE WHEN baja THEN
        'Mismo nombre y marca que el EAN ' || peor_ean || ', clasificado como ' || p || ' con evidencia directa; '
        || 'ante la discrepancia entre presentaciones se aplica el criterio más restrictivo.' ELSE motivo END
        AS motivo FROM (SELECT *, CASE peor WHEN 2 THEN 'no_apto' WHEN 1 THEN 'vegetariano' ELSE 'apto' END AS p,
        coalesce(n >= 2 AND peor IS NOT NULL AND ean <> peor_ean AND CASE WHEN estado = 'revisar' THEN peor > 0
          ELSE {_SEV.format('estado')} < peor END, false) AS baja FROM o_{prefix}w)"""
    return f"o_{prefix}d"


@query(
    "reconcile_duplicates",
    f"SELECT ean, estado, fuente_decision, confianza, motivo FROM {_dup_views('dup_', 'v_products')}",
)
def reconcile_duplicates(spark, d):
    return D.reconcile_duplicates(products(spark, d)).select(
        "ean", "estado", "fuente_decision", "confianza", "motivo"
    )


# An earlier state of the products: some with another name or verdict, some that came later, one group more.
VIEWS["v_before"] = """
SELECT ean, CASE WHEN p_partkey % 17 = 0 THEN 'Otro nombre' ELSE nombre END AS nombre, marca,
  CASE WHEN p_partkey % 19 = 0 THEN 'no_apto' ELSE estado END AS estado, fuente_decision, motivo, confianza
FROM v_products WHERE p_partkey % 23 <> 4
UNION ALL SELECT concat('9', substring(ean, 2, 12)), nombre, marca, 'no_apto', 'ingredientes', motivo, confianza
FROM v_products WHERE p_partkey % 29 = 3
"""


@query(
    "reconcile_incremental",
    "SELECT ean, estado, fuente_decision, confianza, motivo FROM o_dup_d",
)
def reconcile_incremental(spark, d):
    """Kept groups of an earlier state, refreshed by what changed since; equals the whole reconciliation."""
    kept = DuplicateGroups(spark, f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}", buckets=16)
    before = view(spark, d, "v_before")
    kept.refresh(before)
    now = products(spark, d).select(*kept.columns)
    kept.refresh(now.exceptAll(before.select(*kept.columns)), before.join(now, "ean", "left_anti"))
    return kept.read().select("ean", "estado", "fuente_decision", "confianza", "motivo")


@query(
    "apply_corrections",
    """SELECT p.ean, coalesce(f.estado, p.estado) AS estado, CASE WHEN f.ean IS NULL THEN fuente_decision ELSE
      'curaduria_humana' END AS fuente_decision, CASE WHEN f.ean IS NULL THEN confianza END AS confianza,
      CASE WHEN f.ean IS NULL THEN motivo ELSE 'Revisado y corregido a mano por ' || revisor END AS motivo
    FROM v_products p LEFT JOIN v_fix f ON f.ean = p.ean""",
)
def apply_corrections(spark, d):
    fixes = view(spark, d, "v_fix").drop("doc_id")
    return D.apply_corrections(products(spark, d), fixes).select(
        "ean", "estado", "fuente_decision", "confianza", "motivo"
    )


@query(
    "corrections_effective",
    """WITH e AS (SELECT lpad((event_id % (SELECT count(*) FROM part))::VARCHAR, 13, '0') AS ean, event_id AS orden,
        CASE event_type WHEN 'view' THEN 'apto' WHEN 'click' THEN 'vegetariano' WHEN 'error' THEN 'no_apto'
        ELSE 'revisar' END AS estado, 'u' || user_id AS revisor FROM events),
    u AS (SELECT *, row_number() OVER (PARTITION BY ean ORDER BY orden DESC) AS i FROM e)
    SELECT u.ean, p.estado AS estado_actual, u.estado AS estado_corregido, revisor, orden FROM u
    JOIN v_products p ON p.ean = u.ean WHERE i = 1 AND p.estado <> u.estado""",
)
def corrections_effective(spark, d):
    from labelproof.bindings.views import sql

    edits = sql(
        spark, d,
        "SELECT lpad(CAST(event_id % (SELECT count(*) FROM part) AS string), 13, '0') AS ean,"
        " event_id AS orden, CASE event_type WHEN 'view' THEN 'apto' WHEN 'click' THEN 'vegetariano'"
        " WHEN 'error' THEN 'no_apto' ELSE 'revisar' END AS estado,"
        " 'u' || CAST(user_id AS string) AS revisor FROM events",
    )
    return D.effective_corrections(edits, products(spark, d))


# --- the decision and the build -----------------------------------------------

CHECK_VIEWS["o_kept"] = """SELECT * FROM o_features"""
_match_views("reg_", "SELECT ean, nombre, marca FROM o_kept", "v_registered")
# The name rules over one food, the brand and the category of the candidate.
_NAME_STATE = r"""CASE WHEN t LIKE '%leche%' OR t LIKE '%miel%' OR t LIKE '%gelatina%' THEN
    CASE WHEN t LIKE '%coco%' THEN 'apto' ELSE 'no_apto' END
  WHEN t LIKE '%coco%' OR t LIKE '%girasol%' THEN 'apto' WHEN regexp_matches(t, '^(harina|azucar)') THEN 'apto'
  WHEN categoria = 'Lácteos' THEN 'no_apto' ELSE 'revisar' END"""
_NAME_REASON = r"""CASE WHEN k <> '' AND t LIKE '%coco%' THEN '"' || k || ' de coco": versión vegetal'
  WHEN k <> '' THEN '"' || k || '" es de origen animal'
  WHEN t LIKE '%de girasol de coco%' THEN 'Base vegetal declarada: "girasol de coco"'
  WHEN t LIKE '%de trigo de coco%' THEN 'Base vegetal declarada: "trigo de coco"'
  WHEN t LIKE '%de girasol%' THEN 'Base vegetal declarada: "girasol"'
  WHEN t LIKE '%de coco%' THEN 'Base vegetal declarada: "coco"'
  WHEN regexp_matches(t, '^(harina|azucar)') THEN '"' || regexp_extract(t, '^[a-z]+')
    || '" es de origen vegetal o mineral' WHEN categoria = 'Lácteos' THEN 'Rubro de origen animal: Lácteos'
  ELSE 'Sin datos suficientes para clasificar por nombre' END"""
CHECK_VIEWS["o_cand_ev"] = f"""SELECT f.*, r.rnpa, p.off_labels, p.off_analysis, p.off_txt, p.off_tags,
    p.off_image, p.off_categories,
    CASE WHEN uf THEN 'ingredientes_super' ELSE 'ingredientes' END AS i_fuente,
    CASE WHEN uf THEN t.estado ELSE coalesce(e.estado, 'revisar') END AS i_estado,
    CASE WHEN uf THEN t.motivo ELSE coalesce(e.motivo, 'El producto no publica su lista de ingredientes') END
      AS i_motivo,
    CASE WHEN uf THEN t.n_ingredientes ELSE coalesce(e.n_ingredientes, 0) END AS i_n,
    coalesce(a.estado, 'revisar') AS a_estado, a.fuente AS a_fuente, a.motivo AS a_motivo,
    strip_accents(lower(f.nombre)) AS t,
    coalesce(regexp_extract(strip_accents(lower(f.nombre)), 'leche|miel|gelatina'), '') AS k
  FROM (SELECT f.*, coalesce(f.ficha_ingredientes <> '' AND t.estado <> 'revisar' AND (coalesce(e.estado, 'revisar')
      = 'revisar' OR {_SEV.format('t.estado')} > {_SEV.format('e.estado')}), false) AS uf FROM o_kept f
      LEFT JOIN o_ev t ON t.src = 'text' AND t.o = f.ficha_o LEFT JOIN o_payload_ev e ON e.o = f.payload_o) f
  LEFT JOIN o_ev t ON t.src = 'text' AND t.o = f.ficha_o LEFT JOIN o_payload_ev e ON e.o = f.payload_o
  LEFT JOIN v_payload p ON p.o = f.payload_o LEFT JOIN o_analysis a ON a.o = f.payload_o
  LEFT JOIN o_reg_m r ON r.ean = f.ean"""
_AGAINST = "i_estado IN ('vegetariano', 'no_apto')"
_BUT = "', pero su propia lista de ingredientes dice lo contrario: ' || lower(i_motivo)"
CHECK_VIEWS["o_decide"] = f"""SELECT *, CASE paso WHEN 'r' THEN 'certificacion_oficial' WHEN 'l' THEN 'off_label'
    WHEN 's' THEN 'sello_super' WHEN 'ia' THEN i_fuente WHEN 'i' THEN i_fuente WHEN 'a' THEN a_fuente
    WHEN 'n' THEN 'heuristica' ELSE 'sin_datos' END AS fuente,
  CASE WHEN paso IN ('r', 'l', 's') THEN CASE WHEN {_AGAINST} THEN 'revisar' ELSE 'apto' END
    WHEN paso = 'ia' THEN CASE WHEN i_estado = a_estado OR mantiene THEN i_estado
      WHEN {_SEV.format('i_estado')} >= {_SEV.format('a_estado')} THEN i_estado ELSE a_estado END
    WHEN paso = 'i' THEN i_estado WHEN paso = 'a' THEN a_estado WHEN paso = 'n' THEN n_estado ELSE 'revisar' END
    AS estado,
  CASE paso WHEN 'r' THEN CASE WHEN {_AGAINST} THEN 'ANMAT lo registra con atributo vegano (RNPA ' || rnpa || ')'
      || {_BUT} ELSE 'Registro oficial de ANMAT con atributo vegano (RNPA ' || rnpa || ')' END
    WHEN 'l' THEN CASE WHEN {_AGAINST} THEN 'El fabricante lo declara vegano' || {_BUT}
      ELSE 'Declarado vegano por el fabricante' END
    WHEN 's' THEN CASE WHEN {_AGAINST} THEN 'El supermercado lo certifica como vegano' || {_BUT}
      ELSE 'Certificado como vegano en la ficha del supermercado' END
    WHEN 'ia' THEN i_motivo || CASE WHEN i_estado = a_estado THEN '. Coincide con el análisis de Open Food Facts.'
      WHEN mantiene THEN '. Open Food Facts coincide en que no es vegano, pero no se pronuncia sobre el estado vegetariano.'
      ELSE '. Open Food Facts dice «' || a_estado || '»; ante la discrepancia se toma el criterio más restrictivo.' END
    WHEN 'i' THEN i_motivo WHEN 'a' THEN a_motivo WHEN 'n' THEN {_NAME_REASON}
    ELSE CASE WHEN i_n > 0 THEN i_motivo ELSE {_NAME_REASON} END END AS motivo
  FROM (SELECT *, i_estado = 'vegetariano' AND a_estado = 'no_apto' AND off_analysis = 'en:non-vegan' AS mantiene,
      {_NAME_STATE} AS n_estado,
      CASE WHEN rnpa IS NOT NULL THEN 'r' WHEN off_labels LIKE '%en:vegan' THEN 'l'
        WHEN ',' || ficha_sellos || ',' LIKE '%,vegan,%' THEN 's'
        WHEN i_estado <> 'revisar' AND a_estado <> 'revisar' THEN 'ia' WHEN i_estado <> 'revisar' THEN 'i'
        WHEN a_estado <> 'revisar' THEN 'a' WHEN {_NAME_STATE} <> 'revisar' THEN 'n' ELSE 'x' END AS paso
    FROM o_cand_ev)"""


def _judged(spark, d):
    return P.judged_candidates(*build_inputs(spark, d), view(spark, d, "v_registered"))


@query("decide", "SELECT ean, estado, fuente, motivo FROM o_decide")
def decide(spark, d):
    return _judged(spark, d).select("ean", "decision.*")


CHECK_VIEWS["o_coverage"] = """SELECT count(*) AS muestra,
  count(*) FILTER (WHERE coalesce(off_txt, '') <> '' OR coalesce(off_tags, '') <> ''
    OR coalesce(ficha_ingredientes, '') <> '') AS con_ingredientes,
  count(*) FILTER (WHERE coalesce(off_txt, '') <> '') AS con_texto_ingredientes,
  count(*) FILTER (WHERE coalesce(off_tags, '') <> '') AS con_taxonomia,
  count(*) FILTER (WHERE off_analysis NOT IN ('', 'en:vegan-status-unknown')) AS con_analisis_resuelto,
  count(*) FILTER (WHERE off_labels LIKE '%en:vegan') AS con_label_vegan,
  count(*) FILTER (WHERE coalesce(ficha_ingredientes, '') <> '') AS con_ingredientes_super,
  count(*) FILTER (WHERE ',' || ficha_sellos || ',' LIKE '%,vegan,%') AS con_sello_vegano_super,
  count(rnpa) AS certificados, count(*) FILTER (WHERE estado <> 'revisar') AS resueltos,
  count(*) FILTER (WHERE estado = 'revisar') AS en_revisar FROM o_decide"""
_PCT = """SELECT *, round_even(100.0::DOUBLE * con_ingredientes / muestra, 2) AS cobertura_ingredientes_pct,
  round_even(100.0::DOUBLE * resueltos / muestra, 2) AS tasa_resolucion_pct FROM o_coverage"""


@query("coverage_report", _PCT)
def coverage_report(spark, d):
    return A.report(_judged(spark, d))


@query(
    "coverage_band",
    f"""SELECT muestra, CASE WHEN cobertura_ingredientes_pct > 25 THEN 'alcanza para entrenar'
      WHEN cobertura_ingredientes_pct < 10 THEN 'manda la heuristica de nombre' ELSE 'viable con poco dato' END
      AS lectura FROM ({_PCT})""",
)
def coverage_band(spark, d):
    report = A.report(_judged(spark, d))
    return report.select("muestra", A.band(F.col("cobertura_ingredientes_pct")).alias("lectura"))


CHECK_VIEWS["o_build0"] = """SELECT ean, nombre, marca, categoria, estado, fuente AS fuente_decision,
  NULL::DOUBLE AS confianza, coalesce(nullif(off_txt, ''), ficha_ingredientes) AS ingredients_text,
  nullif(off_image, '') AS imagen_url, precio_ref, motivo, coalesce(off_categories, '') AS cats FROM o_decide"""
_dup_views("bld_", "o_build0")
CHECK_VIEWS["o_build"] = """SELECT b.ean, nombre, marca, categoria, coalesce(f.estado, b.estado) AS estado,
    CASE WHEN f.ean IS NULL THEN fuente_decision ELSE 'curaduria_humana' END AS fuente_decision,
    ingredients_text, imagen_url, precio_ref,
    CASE WHEN f.ean IS NULL THEN motivo ELSE 'Revisado y corregido a mano por ' || revisor END AS motivo, c.cadenas
  FROM o_bld_d b LEFT JOIN v_fix f ON f.ean = b.ean LEFT JOIN (SELECT ean, string_agg(DISTINCT cadena, ','
    ORDER BY cadena) AS cadenas FROM o_shelf GROUP BY ean) c ON c.ean = b.ean
  WHERE cats <> '' OR coalesce(trim(ingredients_text), '') <> '' OR c.cadenas IS NOT NULL OR f.ean IS NOT NULL
    OR fuente_decision IN ('certificacion_oficial', 'off_label', 'sello_super', 'ingredientes',
      'ingredientes_super', 'off_analysis')"""


def built(spark, d):
    """The judged product table of the build."""
    return P.build_products(
        *build_inputs(spark, d), view(spark, d, "v_registered"), view(spark, d, "v_fix").drop("doc_id")
    )


@query("build_products", "SELECT * FROM o_build")
def build_products(spark, d):
    rows = built(spark, d).drop("confianza")
    return rows.withColumn("cadenas", F.array_join("cadenas", ","))
