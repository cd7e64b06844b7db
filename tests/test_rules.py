"""Literal cases of the evidence, name, brand and text rules."""

from pyspark.sql import functions as F

from labelproof.functions import display as D
from labelproof.functions import text as T
from labelproof.operators import brands as B
from labelproof.operators import evidence as E
from labelproof.operators import ingredients as I
from labelproof.operators import names as N
from labelproof.operators import tags as G

TEXTS = [
    ("Harina de trigo, azúcar, leche en polvo. Puede contener huevo", "vegetariano"),
    ("agua, col 120, Saborizante: miel; sal", "no_apto"),
    ("leche concentrada de coco, agua", "apto"),
    ("agua, sal, emulsionante (INS 471)", "revisar"),
    ("agua, lisozima E-1105", "vegetariano"),
    ("esencia artificial de manteca, azúcar", "apto"),
    ("SABORIZANTE: miel, azúcar", "revisar"),
    ("agua, caldo sabor res", "no_apto"),
    ("colorante, ingredientes", "revisar"),
    ("zumaque, kombu, azúcar", "revisar"),
    ("", "revisar"),
    (None, "revisar"),
]
TAGS = [
    (["en:wheat-flour", "en:sugar"], "apto"),
    (["en:milk", "en:sugar"], "vegetariano"),
    (["en:vegetable-oil-and-lard"], "no_apto"),
    (["en:coconut-milk", "en:water"], "apto"),
    (["en:e471", "en:water"], "revisar"),
    (["es:esencia-de-dulce-de-leche", "en:sugar"], "revisar"),
    (["en:colour"], "revisar"),
    ([], "revisar"),
]
NAMES = [
    ("Leche de almendras", "apto"),
    ("Almond milk original", "apto"),
    ("Chocolate con almendras y leche", "no_apto"),
    ("Helado de banana", "no_apto"),
    ("Miel de caña", "apto"),
    ("Milanesa de soja", "apto"),
    ("Hamburguesa vegana", "apto"),
    ("Sal fina", "apto"),
    ("Arroz con leche", "no_apto"),
    ("Galletitas surtidas", "revisar"),
    ("Leche, de soja y coco", "apto"),
]


def test_text_verdicts(spark):
    df = spark.createDataFrame([(t, e) for t, e in TEXTS], "t string, e string")
    got = I.analyze_text(df, "t", "a").select("t", "e", "a.estado").collect()
    assert [(r.t, r.estado) for r in got] == [(r.t, r.e) for r in got]


def test_tag_verdicts(spark):
    df = spark.createDataFrame(TAGS, "t array<string>, e string")
    got = G.analyze_tags(df, "t", "a").select("t", "e", "a.estado").collect()
    assert [(r.t, r.estado) for r in got] == [(r.t, r.e) for r in got]


def test_trace_tag_is_dropped_only_when_it_is_nowhere_else(spark):
    df = spark.createDataFrame(
        [
            (1, "agua, azúcar. Puede contener leche", ["en:water", "en:sugar", "en:milk"]),
            (2, "agua, leche. Puede contener leche", ["en:water", "en:milk"]),
        ],
        "i int, t string, g array<string>",
    )
    got = E.analyze_product(df, "t", "g", "a").select("i", "a.estado").orderBy("i").collect()
    assert [r.estado for r in got] == ["apto", "vegetariano"]


def test_first_pattern_of_a_token_wins(spark):
    df = spark.createDataFrame([("gelatina sabor leche, agua",)], "t string")
    row = I.analyze_text(df, "t", "a").select("a.estado", "a.detectados").first()
    assert (row.estado, row.detectados) == ("vegetariano", ["leche"])


def test_name_verdicts(spark):
    rows = [(n, None, None, e) for n, e in NAMES]
    df = spark.createDataFrame(rows, "n string, m string, c string, e string")
    got = N.name_heuristic(df, "n", "m", "c", "a").select("n", "e", "a.estado").collect()
    assert [(r.n, r.estado) for r in got] == [(r.n, r.e) for r in got]


def test_punctuation_counts_as_a_word_after_a_keyword(spark):
    df = spark.createDataFrame(
        [("leche, con un coco", None, None), ("leche con un coco", None, None)],
        "n string, m string, c string",
    )
    got = N.name_heuristic(df, "n", "m", "c", "a").select("a.estado").collect()
    assert [r.estado for r in got] == ["no_apto", "apto"]


def test_brand_spelling(spark):
    votes = spark.createDataFrame(
        [
            ("ARCOR", 90), ("Arcor", 3), ("arcor", 50),
            ("Alicante", 16), ("Alícante", 1), ("Mañanita", 40), ("Mananita", 60),
            ("Hellmann's", 1), ("HELLMANNS", 9),
        ],
        "marca string, n bigint",
    )
    got = {r.clave: r.canonica for r in B.canonical(votes).collect()}
    assert got == {
        "arcor": "Arcor", "alicante": "Alicante", "mananita": "Mañanita",
        "hellmanns": "Hellmann's",
    }


def test_secondary_source_does_not_outvote(spark):
    first = spark.createDataFrame([("Arcor", 1)], "marca string, n bigint")
    second = spark.createDataFrame([("ARCOR", 99), ("NUEVA", 5), ("Nueva", 1)], "marca string, n bigint")
    got = {r.marca: r.canonica for r in B.brand_map(first, second).collect()}
    assert got == {"Arcor": "Arcor", "ARCOR": "Arcor", "NUEVA": "Nueva", "Nueva": "Nueva"}


def test_text_keys(spark):
    df = spark.createDataFrame([("Ñandú ½ ﬁn º",), ("7.79e+12",), ("['La Serenísima']",)], "s string")
    got = df.select(
        T.slugify(F.col("s")), T.ean_normalize(F.col("s")), T.brand_key(F.col("s"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("nandu-12-fin-o", None, "nandu 1 2 fin o"),
        ("7-79e-12", "7790000000000", "7 79e 12"),
        ("la-serenisima", None, "la serenisima"),
    ]


def test_ratio_rounding_matches_correct_rounding(spark):
    pairs = [(a, b) for b in (1, 3, 7, 8, 40, 200, 999) for a in range(0, b + 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = df.select("a", "b", D.round_ratio(F.col("a"), F.col("b"), 2).alias("r")).collect()
    assert all(r.r == round(r.a / r.b, 2) for r in got)
