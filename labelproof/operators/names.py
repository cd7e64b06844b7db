"""Verdict of a product name, for products that publish no ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.functions import text as T
from labelproof.functions.patterns import any_of, first_rank, let, literals, lookup, pick, settled
from labelproof.rules import names as N
from labelproof.rules import rows, words
from labelproof.rules.labels import APTO, NO_APTO, REVISAR, SRC_NAME, SRC_NONE

KEYWORDS = words(N.ANIMAL_WORDS)
KEYWORDS_EN = words(N.ANIMAL_WORDS_EN)
MODIFIERS = words(N.PLANT_MODIFIERS)
CLAIMS = words(N.VEGAN_CLAIMS)
COMMODITIES = words(N.COMMODITIES)
FILLERS = words(N.FILLERS)
PREPARATIONS = words(N.DAIRY_PREPARATIONS)
ANIMAL_SECTIONS = words(N.ANIMAL_SECTIONS)
PLANT_SECTIONS = words(N.PLANT_SECTIONS)
OWN = rows(N.OWN_MODIFIERS, 2)


def _has(padded: Column, word: Column) -> Column:
    return F.contains(padded, F.concat(F.lit(" "), word, F.lit(" ")))


def section_decision(category: Column) -> Column:
    """State and reason of a section name; null when it says nothing."""
    animal = F.struct(
        F.lit(NO_APTO).alias("estado"),
        F.concat(F.lit("Rubro de origen animal: "), category).alias("motivo"),
    )
    plant = F.struct(
        F.lit(APTO).alias("estado"),
        F.concat(F.lit("Rubro de origen vegetal: "), category).alias("motivo"),
    )
    return let(
        T.norm_name(category),
        lambda key: F.when(key.rlike(any_of(ANIMAL_SECTIONS)), animal).when(
            key.rlike(any_of(PLANT_SECTIONS)), plant
        ),
    )


def keyword_hits(df: DataFrame, text: str, out: str) -> DataFrame:
    """Animal keywords of a normalised name with the modifier that neutralises each.

    The hits come in keyword order, then in text order; every occurrence of a
    keyword is one hit. The modifier is looked for in the words after the
    keyword, for English keywords also in the words before.
    """
    df = df.withColumn("_padded", T.padded_words(F.col(text)))
    present = F.filter(literals(KEYWORDS), lambda w: _has(F.col("_padded"), w))
    any_word = F.col("_padded").rlike(" (?:" + "|".join(KEYWORDS) + ") ")
    df = df.withColumn("_present", F.when(any_word, present))

    def cut(w: Column) -> Column:
        border = F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b"))
        return F.struct(w.alias("word"), F.split(F.col(text), border).alias("parts"))

    df = df.withColumn("_cut", F.transform("_present", cut))

    def occurrences(k: Column) -> Column:
        last = F.size(k["parts"]) - 1

        def around(i: Column) -> Column:
            after = F.call_function(
                "array_join", F.slice(k["parts"], i + 1, last), k["word"]
            )
            before = F.call_function(
                "array_join", F.slice(k["parts"], F.lit(1), i), k["word"]
            )
            return F.struct(
                k["word"].alias("word"), before.alias("before"), after.alias("after")
            )

        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), around)).otherwise(
            F.array()
        )

    def split_words(t: Column) -> Column:
        return F.filter(F.split(t, " "), lambda w: w != "")

    def window(h: Column) -> Column:
        after = F.array_join(F.slice(split_words(h["after"]), 1, N.WORDS_AFTER), " ")
        back = split_words(h["before"])
        start = F.greatest(F.size(back) - N.WORDS_BEFORE + 1, F.lit(1))
        before = F.array_join(F.slice(back, start, N.WORDS_BEFORE), " ")
        english = h["word"].isin(KEYWORDS_EN)
        near = F.when(english, F.concat_ws(" ", after, before)).otherwise(after)
        return F.struct(h["word"].alias("word"), T.padded_words(near).alias("near"))

    def modified(h: Column) -> Column:
        own = F.coalesce(F.split(lookup(OWN, h["word"]), ", "), F.array().cast("array<string>"))
        found = F.filter(F.concat(literals(MODIFIERS), own), lambda m: _has(h["near"], m))
        return F.struct(h["word"].alias("word"), F.get(found, F.lit(0)).alias("modifier"))

    df = df.withColumn("_hits", F.flatten(F.transform("_cut", occurrences)))
    df = df.withColumn("_near", F.transform("_hits", window))
    return df.withColumn(out, F.transform("_near", modified)).drop(
        "_padded", "_present", "_cut", "_hits", "_near"
    )


def commodity_head(text: Column) -> Column:
    """Plant or mineral product that opens the name; null when none does."""
    filled = F.filter(F.split(text, " "), lambda t: (t != "") & ~t.isin(FILLERS))
    phrases = [c for c in COMMODITIES if " " in c]
    simple = [c for c in COMMODITIES if " " not in c]
    phrase = F.get(F.filter(literals(phrases), lambda c: F.startswith(text, c)), F.lit(0))
    head = F.get(filled, F.lit(0))
    return F.when(
        F.size(filled) > 0,
        F.coalesce(phrase, F.when(F.array_contains(literals(simple), head), head)),
    )


def name_heuristic(
    df: DataFrame, name: str, brand: str, category: str, out: str, needed: Column | None = None
) -> DataFrame:
    """Add the verdict struct of a name; rows that need none keep a cheap null."""
    whole = F.concat(F.col(name), F.lit(" "), F.coalesce(F.col(brand), F.lit("")))
    text = T.norm_name(whole)
    df = df.withColumn("_text", text if needed is None else F.when(needed, text))
    claims = [rf"\b{c}\b" for c in CLAIMS]
    df = df.withColumn("_claim", pick(CLAIMS, first_rank("_text", claims)))
    df = keyword_hits(df, "_text", "_words")
    df = df.withColumn("_section", section_decision(F.col(category)))
    open_hit = F.get(F.filter("_words", lambda h: h["modifier"].isNull()), F.lit(0))
    df = df.withColumn("_open", open_hit["word"])
    df = df.withColumn("_neutral", F.get("_words", F.lit(0)))
    base = F.regexp_extract("_text", "(?U)" + N.BASE_PHRASE, 1)
    df = df.withColumn(
        "_base",
        F.when((base != "") & T.has_word(base, MODIFIERS), base),
    )
    df = df.withColumn("_commodity", commodity_head(F.col("_text")))

    def answer(state: str, reason: Column, source: str = SRC_NAME) -> Column:
        return F.struct(
            F.lit(state).alias("estado"),
            F.lit(source).alias("fuente"),
            reason.alias("motivo"),
        )

    word = F.concat(F.lit('"'), F.col("_open"), F.lit('"'))
    neutral, modifier = F.col("_neutral.word"), F.col("_neutral.modifier")
    phrase = F.when(
        neutral.isin(KEYWORDS_EN), F.concat(modifier, F.lit(" "), neutral)
    ).otherwise(F.concat(neutral, F.lit(" de "), modifier))
    section = F.struct(
        F.col("_section.estado").alias("estado"),
        F.lit(SRC_NAME).alias("fuente"),
        F.col("_section.motivo").alias("motivo"),
    )
    verdict = (
        F.when(F.col("_text").isNull(), F.lit(None))
        .when(
            F.col("_claim").isNotNull(),
            answer(APTO, F.concat(F.lit('El nombre declara "'), F.col("_claim"), F.lit('"'))),
        )
        .when(
            F.col("_open").isNotNull() & (F.col("_section.estado") == APTO),
            answer(
                REVISAR,
                F.concat(
                    word, F.lit(' en el nombre contradice el rubro "'), F.col(category),
                    F.lit('"'),
                ),
            ),
        )
        .when(
            F.col("_open").isin(PREPARATIONS),
            answer(
                NO_APTO,
                F.concat(word, F.lit(" lleva lacteo o huevo salvo que declare lo contrario")),
            ),
        )
        .when(
            F.col("_open").isNotNull(),
            answer(NO_APTO, F.concat(word, F.lit(" es de origen animal"))),
        )
        .when(
            F.col("_neutral").isNotNull(),
            answer(APTO, F.concat(F.lit('"'), phrase, F.lit('": versión vegetal'))),
        )
        .when(
            F.col("_base").isNotNull(),
            answer(APTO, F.concat(F.lit('Base vegetal declarada: "'), F.col("_base"), F.lit('"'))),
        )
        .when(
            F.col("_commodity").isNotNull(),
            answer(
                APTO,
                F.concat(
                    F.lit('"'), F.col("_commodity"),
                    F.lit('" es de origen vegetal o mineral'),
                ),
            ),
        )
        .when(F.col("_section").isNotNull(), section)
        .otherwise(
            answer(
                REVISAR,
                F.lit("Sin datos suficientes para clasificar por nombre"),
                SRC_NONE,
            )
        )
    )
    return df.withColumn(out, settled(verdict)).drop(
        "_text", "_claim", "_words", "_section", "_open", "_neutral", "_base", "_commodity"
    )
