"""Pattern helpers against the plain reading of their lists."""

import re

from pyspark.sql import functions as F

from labelproof.functions import patterns as P
from labelproof.functions import text as T
from labelproof.operators import ingredients as I

TEXTS = [
    "leche", "leche de coco", "dulce de leche", "gelatina", "ins 441", "e 901", "suelto", "suero de leche",
    "sal", "salsa", "soyabean", "caseína", "lácteos", "pavo", "krill", "whey", "bone meal", "", "azucar muy refinada",
    "omega 3 de pescado", "oleomargarine", "fermentos", "enzymes", "glycerine", "soy lecithin", "vitamin d3",
]


def test_rank_is_that_of_the_first_pattern_found(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for patterns in (I.ANIMAL_PATTERNS, I.AMBIGUOUS_PATTERNS):
        got = {r.t: r.r for r in rows.select("t", P.first_rank("t", patterns).alias("r")).collect()}
        for t in TEXTS:
            first = next((i for i, p in enumerate(patterns) if re.search(p, t)), None)
            assert got[t] == first, t


def test_one_alternation_matches_where_any_pattern_does():
    for patterns in (I.ANIMAL_PATTERNS, I.AMBIGUOUS_PATTERNS, I.PLANT_PATTERNS):
        one = re.compile(P.any_of(patterns))
        for t in TEXTS + [re.sub(r"\\b|\W", " ", p).strip() for p in patterns]:
            assert bool(one.search(t)) == any(re.search(p, t) for p in patterns), t


def test_a_hit_takes_few_tests_and_a_common_letter_one():
    """The depth of the tests is that of halving, not the length of the list."""
    sql = P.rank_case("t", I.ANIMAL_PATTERNS)
    depth = deepest = 0
    for word in re.findall(r"CASE|END", sql):
        depth += 1 if word == "CASE" else -1
        deepest = max(deepest, depth)
    assert sql.count("regexp_instr") == len(I.ANIMAL_PATTERNS)
    assert deepest <= 2 + len(I.ANIMAL_PATTERNS).bit_length()
    assert P.any_of([r"\bsal\b", r"\bsoja\b", r"\bagua"]) == r"\b(?:s(?:al\b|oja\b)|agua)"


def test_collapse_keeps_its_results(spark):
    texts = ["a b", " a  b ", "a\tb", "a\u00a0b", "a \n b", "", "  ", "a\u2003\u2003b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    for r in rows.select("t", T.collapse(F.col("t")).alias("now"), old.alias("was")).collect():
        assert r.now == r.was, r.t


def test_the_filter_for_empty_lists_reads_the_list(spark):
    """No query of listed tokens may compute its list again in the test that it isn't empty."""
    from labelproof.queries import evidence_queries as E

    rows = spark.createDataFrame([(1, ["sal", "agua"])], "o long, tokens array<string>").repartition(2)
    df = E._exploded(I.mark_tokens(rows, "tokens", "m"), "m", "token", "skip")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.split("\n") if line.strip(" :+-").startswith("Filter")]
    assert all("regexp" not in line and "zip_with" not in line for line in tests), tests
    assert df.count() == 2


def test_an_alternation_clears_no_groups():
    """Every group that captures is cleared for each text that is tested."""
    for patterns in (I.ANIMAL_PATTERNS, I.AMBIGUOUS_PATTERNS, I.PLANT_PATTERNS):
        assert re.compile(P.any_of(patterns)).groups == 0


def test_tokens_of_loose_texts(spark):
    """White space that a phrase or a share leaves behind, parts of digits, codes in their spaced form."""
    texts = {
        "a  b y trazas de mani. Z 5 %  sal": ["a b", "z sal"],
        "leche  10,5% de  vaca, 12, ١٢, 7up, e-330 , ins.3301x": ["leche 10", "de vaca", "7up", "e 330", "ins", "3301x"],
        "sal puede contener mani;  - pan , ñ, zz": ["sal", "pan", "zz"],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.x for r in rows.select("t", I.ingredient_tokens(T.norm_ingredients(F.col("t"))).alias("x")).collect()}
    for t, wanted in texts.items():
        assert got[t] == wanted, t


def test_only_derived_products_are_searched_for_origins(spark):
    """Kinds of tokens with each kind of hit, and the places where an origin is tested."""
    cases = {"leche vegana": "known", "sabor leche": "ambiguous", "leche": "animal", "gelatina artificial": "animal",
             "sal artificial": "known", "xyz artificial": "unknown", "lecitina": "ambiguous", "colorante": "skip"}
    rows = spark.createDataFrame([(list(cases),)], "tokens array<string>")
    ranked = I.rank_tokens(I.mark_tokens(rows, "tokens", "m"), "m", "r")
    judged = I.judge_tokens(ranked, "r", "j")
    assert {m.token: m.kind for m in judged.first().j} == cases
    plan = judged.select("j")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("isnull(") < plan.index("identic")


def test_shares_take_wide_numbers_for_ties_only(spark):
    from labelproof.functions.display import round_ratio

    pairs = [(n, d) for d in range(0, 41) for n in range(0, d + 1)] + [(28700, 57), (125, 1000), (375, 1000), (9 * 10**9, 7 * 10**8)]
    rows = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = {(r.n, r.d): r.x for r in rows.select("n", "d", round_ratio(F.col("n"), F.col("d"), 2).alias("x")).collect()}
    for (n, d), x in got.items():
        assert x == (round(n / d, 2) if d else None), (n, d, x)
    plan = rows.select(round_ratio(F.col("n"), F.col("d"), 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(38,0)" not in plan
