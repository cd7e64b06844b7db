"""Ingredient text evidence.

Everything is local to the row: an ingredient list is an array column that
several projections refine, so the verdict of a text needs no shuffle and no
Python. Each stage is a projection of its own, which keeps the pattern work
from being evaluated more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.display import round_ratio, whole_percent
from labelproof.functions.patterns import (
    UNICODE, add_field, any_of, let, matches, occurs_sql, pick, rank_case, settled,
)
from labelproof.rules import lexicon, lines, rows, words
from labelproof.rules.labels import (
    APTO, MIN_COVERAGE, NO_APTO, REVISAR, SRC_INGREDIENTS, SRC_NONE, VEGETARIANO,
)

ANIMAL = rows(lexicon.ANIMAL_TEXT, 3)
AMBIGUOUS = rows(lexicon.AMBIGUOUS_TEXT, 2)
ANIMAL_PATTERNS = [pattern for _, _, pattern in ANIMAL]
ANIMAL_STATES = [state for state, _, _ in ANIMAL]
ANIMAL_LABELS = [label for _, label, _ in ANIMAL]
DERIVED_RANKS = [i for i, state in enumerate(ANIMAL_STATES) if state == VEGETARIANO]
AMBIGUOUS_PATTERNS = [pattern for _, pattern in AMBIGUOUS]
AMBIGUOUS_LABELS = [label for label, _ in AMBIGUOUS]
PLANT_PATTERNS = lines(lexicon.PLANT_ES_TEXT) + lines(lexicon.PLANT_EN_TEXT)
QUALIFIERS = words(lexicon.PLANT_QUALIFIERS)

_SEVERITY = {VEGETARIANO: 1, NO_APTO: 2}


def severity(state: Column) -> Column:
    """Place of a resolved verdict on the scale; null for an unresolved one."""
    return F.when(state == APTO, 0).when(state == VEGETARIANO, 1).when(state == NO_APTO, 2)


def trace_phrases(norm: Column) -> Column:
    """Cross-contamination phrases of a normalised text, in order."""
    found = F.regexp_extract_all(norm, F.lit(UNICODE + lexicon.TRACE_PHRASE), 0)
    return F.transform(found, F.trim)


def without_traces(norm: Column) -> Column:
    """Normalised text without its cross-contamination phrases."""
    return F.regexp_replace(norm, UNICODE + lexicon.TRACE_PHRASE, " ")


def ingredient_tokens(norm: Column) -> Column:
    """Ordered single ingredients of a normalised text, in which white space is single spaces."""
    flat = F.regexp_replace(without_traces(norm), r"[()\[\]{}]", ",")
    parts = F.split(flat, UNICODE + r"[,;:.]|\band\b|\by\b(?= )")

    def clean(part: Column) -> Column:
        share = F.regexp_replace(part, UNICODE + r"\d+([.,]\d+)?\s*%", " ")
        plain = F.when(F.contains(part, F.lit("%")), share).otherwise(part)
        # White space inside a part is loose only where a phrase or a share was taken out.
        loose = F.contains(part, F.lit("%")) | F.contains(part, F.lit("  "))
        return F.btrim(F.when(loose, T.collapse(plain)).otherwise(part), F.lit(" -*·•"))

    # A part that starts with a plain letter is no number.
    return F.filter(
        F.transform(parts, clean),
        lambda t: (F.length(t) >= 2) & (t.between("a", "zz") | ~matches(t, r"^\d+\z")),
    )


def is_class_or_noise(token: Column) -> Column:
    """Additive class words and label text, which are no ingredients."""
    return matches(token, lexicon.CLASS_WORDS) | matches(token, lexicon.LABEL_NOISE)


def opens_flavour(token: Column) -> Column:
    """True where the text starts with a word that names a flavour."""
    return matches(token, f"^(?:{lexicon.FLAVOUR_WORDS})")


def is_plant(token: Column) -> Column:
    """True where a plant, mineral or synthetic rule is found."""
    return matches(token, any_of(PLANT_PATTERNS))


def declares_origin(token: Column) -> Column:
    """True where the text declares a plant or artificial origin."""
    return matches(token, lexicon.DECLARED_ORIGIN)


def names_flavour(token: Column) -> Column:
    """True where no animal term stands up to the first flavour word."""
    pattern = UNICODE + f"^(.*?{lexicon.FLAVOUR_WORDS})"
    prefix = F.regexp_extract(token, pattern, 1)
    return let(prefix, lambda p: (p != "") & ~matches(p, any_of(ANIMAL_PATTERNS)))


def flavour_label(token: Column) -> Column:
    """Reason of an ambiguous flavour name."""
    return F.concat(F.lit("«"), token, F.lit("» nombra un sabor sin declarar su origen"))


def mark_tokens(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Tokens with their class/noise mark and the flavour mark of the token before."""
    marked = F.transform(
        F.col(tokens),
        lambda t: F.struct(
            t.alias("token"),
            is_class_or_noise(t).alias("skip"),
            opens_flavour(t).alias("opens"),
        ),
    )
    df = df.withColumn("_marked", marked)
    none = F.struct(
        F.lit("").alias("token"), F.lit(False).alias("skip"), F.lit(False).alias("opens")
    )
    before = F.slice(F.concat(F.array(none), "_marked"), F.lit(1), F.size("_marked"))

    def with_flavour(m: Column, b: Column) -> Column:
        return F.struct(
            m["token"].alias("token"),
            m["skip"].alias("skip"),
            (b["skip"] & b["opens"]).alias("under_flavour"),
        )

    return df.withColumn(out, F.zip_with("_marked", before, with_flavour)).drop("_marked")


def rank_tokens(df: DataFrame, marked: str, out: str) -> DataFrame:
    """Marked tokens with their lexicon hits; later lexicons only see the misses."""
    fields = ["token", "skip", "under_flavour"]
    steps = {
        "animal": f"CASE WHEN NOT m.skip THEN {rank_case('m.token', ANIMAL_PATTERNS)} END",
        "ambiguous": "CASE WHEN NOT m.skip AND m.animal IS NULL THEN "
        f"{rank_case('m.token', AMBIGUOUS_PATTERNS)} END",
        "plant": "NOT m.skip AND m.animal IS NULL AND m.ambiguous IS NULL AND "
        + occurs_sql("m.token", UNICODE + any_of(PLANT_PATTERNS)),
    }
    source = marked
    for name, value in steps.items():
        df = df.withColumn(out, add_field(source, fields, name, value))
        fields, source = [*fields, name], out
    return df


def judge_tokens(df: DataFrame, ranked: str, out: str) -> DataFrame:
    """Kind, severity and label of each token after the flavour rule.

    Kinds: ``skip``, ``animal``, ``ambiguous``, ``known`` and ``unknown``.
    """

    def judge(m: Column) -> Column:
        token = m["token"]
        # Only a token of a derived product is searched for origins and flavours.
        plain = F.when(m["ambiguous"].isNotNull(), "ambiguous").when(m["plant"], "known").otherwise("unknown")
        kind = (
            F.when(m["skip"], "skip")
            .when(m["animal"].isNull(), plain)
            .when(~m["animal"].isin(DERIVED_RANKS), "animal")
            .when(declares_origin(token), "known")
            .when(m["under_flavour"] | names_flavour(token), "flavour")
            .otherwise("animal")
        )
        return F.struct(
            token.alias("token"),
            kind.alias("kind"),
            m["animal"].alias("animal"),
            m["ambiguous"].alias("ambiguous"),
        )

    def label(m: Column) -> Column:
        flavour = m["kind"] == "flavour"
        return F.struct(
            m["token"].alias("token"),
            F.when(flavour, "ambiguous").otherwise(m["kind"]).alias("kind"),
            F.when(m["kind"] == "animal", severity(pick(ANIMAL_STATES, m["animal"]))).alias("severity"),
            F.when(m["kind"] == "animal", pick(ANIMAL_LABELS, m["animal"]))
            .when(flavour, flavour_label(m["token"]))
            .when(m["kind"] == "ambiguous", pick(AMBIGUOUS_LABELS, m["ambiguous"]))
            .alias("label"),
        )

    df = df.withColumn("_judged", F.transform(ranked, judge))
    return df.withColumn(out, F.transform("_judged", label)).drop("_judged")


def _labels(judged: Column, kind: str) -> Column:
    return F.array_distinct(
        F.transform(F.filter(judged, lambda m: m["kind"] == kind), lambda m: m["label"])
    )


def summarise(df: DataFrame, judged: str, out: str) -> DataFrame:
    """Facts of a judged list: worst severity, labels, counts."""
    items = F.col(judged)
    worst = F.array_max(F.transform(items, lambda m: m["severity"]))
    facts = F.struct(
        F.coalesce(worst, F.lit(0)).alias("worst"),
        _labels(items, "animal").alias("detectados"),
        _labels(items, "ambiguous").alias("ambiguos"),
        F.size(F.filter(items, lambda m: ~m["kind"].isin("skip", "unknown"))).alias("known"),
        F.size(F.filter(items, lambda m: m["kind"] != "skip")).alias("evaluated"),
    )
    df = df.withColumn("_facts", facts)
    reached = F.get(
        F.filter(items, lambda m: m["severity"] == F.col("_facts.worst")), F.lit(0)
    )
    ratio = F.coalesce(
        F.try_divide(F.col("_facts.known").cast("double"), F.col("_facts.evaluated")),
        F.lit(0.0),
    )
    return df.withColumn(
        out, F.struct(F.col("_facts.*"), reached["label"].alias("reason"), ratio.alias("ratio"))
    ).drop("_facts")


def evidence(
    facts: Column,
    total: Column,
    traces: Column,
    few_text: Column,
    clean_text: Column,
    doubt_text: str,
    missing_text: str,
) -> Column:
    """Verdict struct of a summarised list; an empty list stays unresolved."""
    share = F.coalesce(
        round_ratio(facts["known"], facts["evaluated"], 2), F.lit(0.0)
    )
    first_doubt = F.get(facts["ambiguos"], F.lit(0))
    doubts = F.size(facts["ambiguos"])
    state = (
        F.when(facts["worst"] == 2, NO_APTO)
        .when(facts["worst"] == 1, VEGETARIANO)
        .when((doubts > 0) | (facts["ratio"] < MIN_COVERAGE), REVISAR)
        .otherwise(APTO)
    )
    reason = (
        F.when(
            facts["worst"] == 2,
            F.concat(F.lit("Contiene "), facts["reason"], F.lit(", de origen animal")),
        )
        .when(
            facts["worst"] == 1,
            F.concat(
                F.lit("Contiene "), facts["reason"],
                F.lit(": es vegetariano pero no vegano"),
            ),
        )
        .when(
            doubts > 0,
            F.concat(
                F.lit(doubt_text), doubts.cast("string"),
                F.lit(" de origen no declarado: "), first_doubt,
            ),
        )
        .when(facts["ratio"] < MIN_COVERAGE, few_text)
        .otherwise(clean_text)
    )
    empty = F.coalesce(total, F.lit(0)) == 0
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(empty, REVISAR).otherwise(state).alias("estado"),
        F.when(empty, missing_text).otherwise(reason).alias("motivo"),
        F.when(empty, none).otherwise(facts["detectados"]).alias("detectados"),
        F.when(empty, none).otherwise(facts["ambiguos"]).alias("ambiguos"),
        F.when(empty, 0.0).otherwise(share).alias("cobertura"),
        F.when(empty, 0).otherwise(total).alias("n_ingredientes"),
        F.when(empty, none).otherwise(traces).alias("trazas"),
        F.when(empty, SRC_NONE).otherwise(F.lit(SRC_INGREDIENTS)).alias("fuente"),
    )


def listed(df: DataFrame, text: str) -> DataFrame:
    """Add the single ingredients and the trace phrases of an ingredient text column."""
    df = df.withColumn("_norm", T.norm_ingredients(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_tokens", ingredient_tokens(F.col("_norm")))
    return df.withColumn("_traces", trace_phrases(F.col("_norm"))).drop("_norm")


def analyze_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the evidence struct of an ingredient text column."""
    df = mark_tokens(listed(df, text), "_tokens", "_marks")
    df = rank_tokens(df, "_marks", "_ranks")
    df = judge_tokens(df, "_ranks", "_items")
    return concluded(df, "_items", out).drop("_marks", "_ranks")


def concluded(df: DataFrame, items: str, out: str) -> DataFrame:
    """Add the evidence struct of a listed text whose tokens are judged."""
    df = summarise(df, items, "_sum")
    facts, total = F.col("_sum"), F.size("_tokens")
    known = whole_percent(facts["ratio"])
    verdict = evidence(
        facts,
        total,
        F.col("_traces"),
        F.concat(
            F.lit("Solo se reconoció el "), known,
            F.lit(" de los ingredientes: no alcanza para afirmar que sea vegano"),
        ),
        F.concat(
            F.lit("Ningún ingrediente de origen animal en los "), total.cast("string"),
            F.lit(" declarados (se reconoció el "), known, F.lit(")"),
        ),
        "Sin ingredientes animales claros, pero hay ",
        "El producto no publica su lista de ingredientes",
    )
    return df.withColumn(out, settled(verdict)).drop("_tokens", "_traces", items, "_sum")
