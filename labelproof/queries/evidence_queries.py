"""Ingredient text and tag evidence queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelproof.bindings.views import view
from labelproof.functions import text as T
from labelproof.functions.patterns import settled
from labelproof.operators import evidence as E
from labelproof.operators import highlight as H
from labelproof.operators import ingredients as I
from labelproof.operators import tags as G
from labelproof.operators.skew import shared_folder
from labelproof.operators.token_dictionary import TokenDictionary
from labelproof.queries.base import CHECK_VIEWS, query

CHECK_VIEWS["o_norm"] = r"""SELECT o, ean, txt, tags, trim(regexp_replace(regexp_replace(
  strip_accents(lower(txt)), '\b(ins|e)[\s.-]*(\d{3,4})\b', '\1 \2', 'g'), '\s+', ' ', 'g')) AS norm
  FROM v_label"""
_TRACE = "(puede contener|contiene trazas|trazas de)[^.;]*"
CHECK_VIEWS["o_body"] = f"""SELECT o, norm, regexp_replace(norm, '{_TRACE}', ' ', 'g') AS body,
  trim(regexp_extract(norm, '{_TRACE}')) AS trazas FROM o_norm"""
CHECK_VIEWS["o_part"] = r"""SELECT o, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT o,
  string_split_regex(translate(body, '()[]{}', ',,,,,,'), '[,;:.]|\band\b|\by\b ') AS l FROM o_body)"""
CHECK_VIEWS["o_tok"] = r"""SELECT o, row_number() OVER (PARTITION BY o ORDER BY i) - 1 AS pos, t AS token
  FROM (SELECT o, i, trim(regexp_replace(regexp_replace(p, '\d+([.,]\d+)?\s*%', ' ', 'g'), '\s+', ' ', 'g'),
    ' -*·•') AS t FROM o_part) WHERE length(t) >= 2 AND NOT regexp_full_match(t, '\d+')"""
CHECK_VIEWS["o_mark"] = """SELECT o, pos, token, token = 'saborizante' AS skip,
  coalesce(lag(token) OVER (PARTITION BY o ORDER BY pos) = 'saborizante', false) AS bajo_sabor FROM o_tok"""
CHECK_VIEWS["o_hit"] = r"""SELECT *,
  CASE WHEN skip THEN NULL WHEN token LIKE '%gelatina%' THEN 'gelatina'
    WHEN regexp_matches(token, '\bleche\b') AND token NOT LIKE '%leche de coco%' THEN 'leche'
    WHEN regexp_matches(token, '\bmiel\b') AND token NOT LIKE '%miel de coco%' THEN 'miel' END AS animal,
  CASE WHEN NOT skip AND token LIKE '%lecitina%' THEN
    'lecitina sin origen declarado (suele ser de soja, pero no está aclarado)' END AS ambiguo,
  NOT skip AND regexp_matches(token, '\b(coco|sal|ins 330|harina|trigo|azucar|girasol)\b')
    AND token NOT LIKE '%lecitina%' AND token NOT LIKE '%gelatina%' AS vegetal FROM o_mark"""
CHECK_VIEWS["o_text_item"] = """SELECT o, pos, token,
  CASE WHEN skip THEN 'skip' WHEN animal IN ('leche', 'miel') AND token LIKE '%artificial%' THEN 'known'
    WHEN animal IN ('leche', 'miel') AND (bajo_sabor OR token LIKE 'sabor %') THEN 'ambiguous'
    WHEN animal IS NOT NULL THEN 'animal' WHEN ambiguo IS NOT NULL THEN 'ambiguous'
    WHEN vegetal THEN 'known' ELSE 'unknown' END AS kind,
  CASE WHEN animal IN ('leche', 'miel') AND (bajo_sabor OR token LIKE 'sabor %')
      AND token NOT LIKE '%artificial%' THEN '«' || token || '» nombra un sabor sin declarar su origen'
    WHEN animal IN ('leche', 'miel') AND token LIKE '%artificial%' THEN NULL
    ELSE coalesce(animal, ambiguo) END AS label FROM o_hit"""
CHECK_VIEWS["o_tag"] = """SELECT o, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS tag
  FROM (SELECT o, string_split(tags, ',') AS l FROM v_label)"""
CHECK_VIEWS["o_tag_item"] = """SELECT t.o, pos, tag, body = 'colour' AS clase,
  CASE WHEN body IN ('gelatin', 'gelatin-and-salt', 'gelatina-artificial', 'sabor-gelatina') THEN 'gelatina'
    WHEN body IN ('milk', 'milk-and-salt') THEN 'leche' WHEN body IN ('honey', 'honey-and-salt') THEN 'miel'
    END AS animal,
  CASE WHEN body IN ('lecithin', 'lecithin-and-salt') THEN 'lecitina sin origen declarado (suele ser de soja)'
    WHEN body IN ('sabor-lecitina', 'lecitina-artificial')
      THEN 'lecitina sin origen declarado (suele ser de soja, pero no está aclarado)'
    WHEN body IN ('sabor-leche', 'sabor-miel')
      THEN '«' || replace(body, '-', ' ') || '» nombra un sabor sin declarar su origen' END AS ambiguo,
  body IN ('sumac', 'zumaque-artificial', 'sabor-zumaque', 'leche-artificial', 'miel-artificial') AS nada
  FROM (SELECT *, lower(split_part(tag, ':', 2)) AS body FROM o_tag) t"""
CHECK_VIEWS["o_tag_kind"] = """SELECT i.o, pos, tag, clase, CASE WHEN animal IS NOT NULL THEN 'animal'
    WHEN ambiguo IS NOT NULL THEN 'ambiguous' WHEN nada OR clase THEN 'unknown' ELSE 'known' END AS kind,
  coalesce(animal, ambiguo) AS label,
  coalesce(b.trazas LIKE '%' || animal || '%' AND b.body NOT LIKE '%' || animal || '%', false) AS traza
  FROM o_tag_item i JOIN o_body b ON b.o = i.o"""
CHECK_VIEWS["o_item"] = """SELECT 'text' AS src, o, pos, kind, label FROM o_text_item
  UNION ALL SELECT 'tags', o, pos, CASE WHEN clase THEN 'skip' ELSE kind END, label FROM o_tag_kind
  UNION ALL SELECT 'ptags', k.o, pos, CASE WHEN clase THEN 'skip' ELSE kind END, label FROM o_tag_kind k
    JOIN v_payload p ON p.o = k.o WHERE off_tags <> '' AND NOT (traza AND off_txt <> '')"""
CHECK_VIEWS["o_labels"] = """SELECT src, o, kind, string_agg(label, '|' ORDER BY p) AS l, count(*) AS n,
  arg_min(label, p) AS primero FROM (SELECT src, o, kind, label, min(pos) AS p FROM o_item
    WHERE kind IN ('animal', 'ambiguous') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
CHECK_VIEWS["o_sum"] = """SELECT src, o, count(*) AS n, count(*) FILTER (WHERE kind <> 'skip') AS evaluados,
  count(*) FILTER (WHERE kind IN ('animal', 'ambiguous', 'known')) AS conocidos,
  coalesce(max(CASE WHEN kind <> 'animal' THEN 0 WHEN label = 'gelatina' THEN 2 ELSE 1 END), 0) AS peor,
  arg_max(label, CASE WHEN label = 'gelatina' THEN 200000 ELSE 100000 END - pos)
    FILTER (WHERE kind = 'animal') AS causa FROM o_item GROUP BY 1, 2"""
CHECK_VIEWS["o_ev"] = """SELECT s.src, s.o, n::BIGINT AS n_ingredientes,
  CASE peor WHEN 2 THEN 'no_apto' WHEN 1 THEN 'vegetariano' ELSE CASE WHEN m.n2 > 0 OR r < 0.6
    THEN 'revisar' ELSE 'apto' END END AS estado,
  CASE WHEN peor = 2 THEN 'Contiene ' || causa || ', de origen animal'
    WHEN peor = 1 THEN 'Contiene ' || causa || ': es vegetariano pero no vegano'
    WHEN m.n2 > 0 THEN CASE src WHEN 'text' THEN 'Sin ingredientes animales claros, pero hay '
      ELSE 'Sin ingredientes animales, pero hay ' END || m.n2 || ' de origen no declarado: ' || m.primero
    WHEN r < 0.6 THEN 'Solo se reconoció el ' || pct || '% de los ' || CASE src WHEN 'text' THEN ''
      ELSE s.n || ' ' END || 'ingredientes: no alcanza para afirmar que sea vegano'
    ELSE 'Ningún ingrediente de origen animal en' || CASE src WHEN 'text' THEN '' ELSE 'tre' END || ' los '
      || s.n || ' declarados (se reconoció el ' || pct || '%)' END AS motivo,
  coalesce(a.l, '') AS detectados, coalesce(m.l, '') AS ambiguos, round_even(r, 2) AS cobertura
  FROM (SELECT *, CASE WHEN evaluados = 0 THEN 0.0::DOUBLE ELSE conocidos::DOUBLE / evaluados END AS r,
      round_even(CASE WHEN evaluados = 0 THEN 0.0::DOUBLE ELSE conocidos::DOUBLE / evaluados END * 100, 0)::BIGINT
      AS pct FROM o_sum) s
  LEFT JOIN (SELECT src AS s2, o AS o2, l FROM o_labels WHERE kind = 'animal') a ON a.s2 = src AND a.o2 = s.o
  LEFT JOIN (SELECT src AS s2, o AS o2, l, n AS n2, primero FROM o_labels WHERE kind = 'ambiguous') m
    ON m.s2 = src AND m.o2 = s.o"""
_NO_TEXT = "El producto no publica su lista de ingredientes"
_NO_TAGS = "El producto no tiene ingredientes cargados en Open Food Facts"
CHECK_VIEWS["o_payload_ev"] = f"""SELECT p.o, p.ean, p.found, p.off_analysis, p.off_labels, p.off_txt,
    CASE WHEN usa_texto THEN t_e ELSE g_e END AS estado, CASE WHEN usa_texto THEN t_m ELSE g_m END AS motivo,
    CASE WHEN usa_texto THEN t_n ELSE g_n END AS n_ingredientes
  FROM (SELECT *, CASE WHEN t_e <> 'revisar' AND g_e <> 'revisar' THEN (CASE t_e WHEN 'no_apto' THEN 2
      WHEN 'vegetariano' THEN 1 ELSE 0 END) >= (CASE g_e WHEN 'no_apto' THEN 2 WHEN 'vegetariano' THEN 1
      ELSE 0 END) WHEN t_e <> 'revisar' THEN true WHEN g_e <> 'revisar' THEN false ELSE t_n >= g_n END
      AS usa_texto
    FROM (SELECT p.*, coalesce(t.estado, 'revisar') AS t_e, coalesce(t.motivo, '{_NO_TEXT}') AS t_m,
        coalesce(t.n_ingredientes, 0) AS t_n, coalesce(g.estado, 'revisar') AS g_e,
        coalesce(g.motivo, '{_NO_TAGS}') AS g_m, coalesce(g.n_ingredientes, 0) AS g_n
      FROM v_payload p LEFT JOIN o_ev t ON t.src = 'text' AND t.o = p.o AND p.off_txt <> ''
        LEFT JOIN o_ev g ON g.src = 'ptags' AND g.o = p.o)) p"""


def _tokens(spark, d):
    rows = view(spark, d, "v_label").select("o", "txt")
    rows = rows.withColumn("norm", T.norm_ingredients(F.col("txt")))
    return rows.withColumn("tokens", I.ingredient_tokens(F.col("norm")))


def _exploded(df, col, *fields):
    # Settled, or the test for empty lists would compute the list a second time.
    rows = df.withColumn(col, settled(F.col(col))).select("o", F.posexplode(col).alias("pos", "m"))
    return rows.select(
        "o", F.col("pos").cast("bigint").alias("pos"), *[F.col(f"m.{f}").alias(f) for f in fields]
    )


@query(
    "trace_split",
    r"SELECT o, trim(regexp_replace(body, '\s+', ' ', 'g')) AS texto, trazas FROM o_body",
)
def trace_split(spark, d):
    rows = _tokens(spark, d)
    return rows.select(
        "o",
        T.collapse(I.without_traces(F.col("norm"))).alias("texto"),
        F.array_join(I.trace_phrases(F.col("norm")), "|").alias("trazas"),
    )


@query("ingredient_tokens", "SELECT * FROM o_tok")
def ingredient_tokens(spark, d):
    rows = _tokens(spark, d).withColumn("tokens", settled(F.col("tokens")))
    rows = rows.select("o", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("o", F.col("pos").cast("bigint").alias("pos"), "token")


@query("token_class_noise", "SELECT o, pos, token, skip, bajo_sabor AND NOT skip AS under_flavour FROM o_mark")
def token_class_noise(spark, d):
    marked = I.mark_tokens(_tokens(spark, d), "tokens", "m")
    rows = _exploded(marked, "m", "token", "skip", "under_flavour")
    return rows.withColumn("under_flavour", F.col("under_flavour") & ~F.col("skip"))


@query(
    "lexicon_match",
    """SELECT o, pos, token, animal, ambiguo, vegetal AND animal IS NULL AS vegetal FROM o_hit WHERE NOT skip""",
)
def lexicon_match(spark, d):
    ranked = I.rank_tokens(I.mark_tokens(_tokens(spark, d), "tokens", "m"), "m", "r")
    rows = _exploded(ranked, "r", "token", "skip", "animal", "ambiguous", "plant").filter("NOT skip")
    return rows.select(
        "o", "pos", "token",
        I.pick(I.ANIMAL_LABELS, F.col("animal")).alias("animal"),
        I.pick(I.AMBIGUOUS_LABELS, F.col("ambiguous")).alias("ambiguo"),
        F.col("plant").alias("vegetal"),
    )


@query("flavour_rule", "SELECT o, pos, token, kind, label FROM o_text_item")
def flavour_rule(spark, d):
    df = I.rank_tokens(I.mark_tokens(_tokens(spark, d), "tokens", "m"), "m", "r")
    return _exploded(I.judge_tokens(df, "r", "j"), "j", "token", "kind", "label")


def _flat(rows, struct, *keep):
    lists = ("detectados", "ambiguos")
    return rows.select(
        *keep,
        *[F.col(f"{struct}.{c}").alias(c) for c in ("estado", "motivo", "cobertura")],
        F.col(f"{struct}.n_ingredientes").cast("bigint").alias("n_ingredientes"),
        *[F.array_join(f"{struct}.{c}", "|").alias(c) for c in lists],
    )


@query(
    "ingredients_verdict",
    """SELECT o, estado, motivo, cobertura, n_ingredientes, detectados, ambiguos FROM o_ev WHERE src = 'text'""",
)
def ingredients_verdict(spark, d):
    rows = view(spark, d, "v_label").select("o", "txt")
    return _flat(I.analyze_text(rows, "txt", "e"), "e", "o")


@query(
    "ingredients_by_dictionary",
    """SELECT o, estado, motivo, cobertura, n_ingredientes, detectados, ambiguos FROM o_ev WHERE src = 'text'""",
)
def ingredients_by_dictionary(spark, d):
    """The same verdicts with each distinct token judged once: half of the rows first, then all of them."""
    rows = view(spark, d, "v_label").select("o", "txt")
    kept = TokenDictionary(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    kept.refresh(I.listed(rows.filter(F.crc32(F.col("o").cast("string")) % 2 == 0), "txt"), "_tokens")
    return _flat(kept.analyze_text(rows, "o", "txt", "e"), "e", "o")


@query(
    "counts_by_state",
    "SELECT estado, count(*) AS n FROM o_ev WHERE src = 'text' GROUP BY estado",
)
def counts_by_state(spark, d):
    rows = view(spark, d, "v_label").select("o", "txt")
    judged = I.analyze_text(rows, "txt", "e")
    return judged.groupBy(F.col("e.estado").alias("estado")).agg(F.count("*").alias("n"))


def _tag_rows(spark, d):
    rows = view(spark, d, "v_label").select("o", "txt", "tags")
    return rows.withColumn("tags", F.split("tags", ","))


@query("tag_classify", "SELECT o, pos, tag, clase AS class_tag, kind, label FROM o_tag_kind")
def tag_classify(spark, d):
    df = G.classify_tags(_tag_rows(spark, d), "tags", "c")
    return _exploded(df, "c", "tag", "class_tag", "kind", "label")


@query(
    "tags_verdict",
    """SELECT o, estado, motivo, cobertura, n_ingredientes, detectados, ambiguos FROM o_ev WHERE src = 'tags'""",
)
def tags_verdict(spark, d):
    return _flat(G.analyze_tags(_tag_rows(spark, d), "tags", "e"), "e", "o")


@query(
    "trace_tags",
    """SELECT v.o, coalesce(k.t, '') AS tags FROM v_label v LEFT JOIN (SELECT o, string_agg(tag, ','
    ORDER BY pos) AS t FROM o_tag_kind WHERE NOT traza GROUP BY o) k ON k.o = v.o""",
)
def trace_tags(spark, d):
    df = G.classify_tags(_tag_rows(spark, d), "tags", "c")
    df = G.drop_trace_tags(df, "c", "txt", "k")
    return df.select("o", F.array_join(F.transform("k", lambda m: m["tag"]), ",").alias("tags"))


def payload_rows(spark, d):
    """Payload columns of every order, empty lists for missing ones."""

    def tags(name):
        return F.filter(F.split(name, ","), lambda t: t != "").alias(name)

    rows = view(spark, d, "v_payload")
    return rows.select(
        "o", "ean", "found", F.col("off_txt").alias("off_text"),
        tags("off_tags"), tags("off_analysis"), tags("off_labels"),
    )


@query("evidence_combine", "SELECT o, estado, motivo, n_ingredientes FROM o_payload_ev")
def evidence_combine(spark, d):
    df = E.analyze_product(payload_rows(spark, d), "off_text", "off_tags", "e")
    return df.select(
        "o", "e.estado", "e.motivo", F.col("e.n_ingredientes").cast("bigint").alias("n_ingredientes")
    )


CHECK_VIEWS["o_two"] = """SELECT p.*, s.sellos, s.ingredientes AS ficha_ingredientes,
    coalesce(s.ingredientes <> '' AND t.estado <> 'revisar' AND (p.estado = 'revisar' OR
      (CASE t.estado WHEN 'no_apto' THEN 2 WHEN 'vegetariano' THEN 1 ELSE 0 END) >
      (CASE p.estado WHEN 'no_apto' THEN 2 WHEN 'vegetariano' THEN 1 ELSE 0 END)), false) AS usa_ficha,
    t.estado AS s_estado, t.motivo AS s_motivo, t.n_ingredientes AS s_n
  FROM o_payload_ev p LEFT JOIN v_sheet s ON s.ean = p.ean LEFT JOIN o_ev t ON t.src = 'text' AND t.o = s.o"""


@query(
    "evidence_two_sources",
    """SELECT o, CASE WHEN usa_ficha THEN s_estado ELSE estado END AS estado,
      CASE WHEN usa_ficha THEN s_motivo ELSE motivo END AS motivo,
      CASE WHEN usa_ficha THEN 'ingredientes_super' ELSE 'ingredientes' END AS fuente FROM o_two""",
)
def evidence_two_sources(spark, d):
    sheets = view(spark, d, "v_sheet").select("ean", "ingredientes")
    df = payload_rows(spark, d).join(sheets, "ean", "left")
    df = E.analyze_product(df, "off_text", "off_tags", "a")
    df = I.analyze_text(df, "ingredientes", "b")
    both = E.two_sources(F.col("a"), F.col("b"), F.col("ingredientes"))
    df = df.withColumn("r", both)
    return df.select("o", "r.evidence.estado", "r.evidence.motivo", F.col("r.source").alias("fuente"))


@query(
    "trigger_term",
    r"""SELECT o, motivo, CASE WHEN motivo LIKE 'Contiene %' THEN
      regexp_extract(motivo, '^Contiene ([a-z]+)', 1) END AS termino FROM o_ev WHERE src = 'text'""",
)
def trigger_term(spark, d):
    rows = I.analyze_text(view(spark, d, "v_label").select("o", "txt"), "txt", "e")
    return rows.select("o", "e.motivo", H.trigger_term(F.col("e.motivo")).alias("termino"))


@query(
    "trigger_spans",
    r"""WITH c AS (SELECT v.o, txt, CASE WHEN e.motivo LIKE 'Contiene %' THEN
        regexp_extract(e.motivo, '^Contiene ([a-z]+)', 1) END AS t
      FROM v_label v JOIN o_ev e ON e.src = 'text' AND e.o = v.o)
    SELECT o, CASE WHEN t IS NULL THEN txt ELSE regexp_replace(txt, '(?i)\b(' || t || ')\b', '[\1]', 'g') END
      AS marcado, CASE WHEN t IS NULL THEN 0 ELSE len(regexp_extract_all(txt, '(?i)\b' || t || '\b')) END
      AS marcas FROM c""",
)
def trigger_spans(spark, d):
    rows = I.analyze_text(view(spark, d, "v_label").select("o", "txt"), "txt", "e")
    spans = H.trigger_spans(F.col("txt"), H.trigger_term(F.col("e.motivo")))
    rows = rows.select("o", spans.alias("s"))
    shown = F.transform(
        "s", lambda p: F.when(p["resaltado"], F.concat(F.lit("["), p["texto"], F.lit("]"))).otherwise(p["texto"])
    )
    marks = F.size(F.filter("s", lambda p: p["resaltado"])).cast("bigint")
    return rows.select("o", F.array_join(shown, "").alias("marcado"), marks.alias("marcas"))
