"""The kept token dictionary against the row-local rules."""

import uuid

from pyspark.sql import functions as F

from labelproof.operators import ingredients as I
from labelproof.operators.skew import shared_folder
from labelproof.operators.token_dictionary import TokenDictionary

TEXTS = [
    "agua, azúcar, leche entera, sal", "saborizante: vainilla, leche", "aromatizantes, queso, miel (natural), 2% sal", "", None, "sal, sal, sal",
    "emulsionante: lecitina de soja, colorante: caramelo, gelatina. Puede contener trazas de leche", "cera, glicerina, vitamina d3",
    "saborizantes. dulce de leche, saborizante idéntico al natural; manteca", "harina de trigo y agua", "xyzzy, plugh, 12",
]


def rows(spark, n=len(TEXTS)):
    return spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(n)], "o bigint, txt string")


def kept(spark):
    return TokenDictionary(spark, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")


def test_equals_the_row_local_rules(spark):
    df = rows(spark, 200).withColumn("clase", F.lit("clash"))
    plain = I.analyze_text(df, "txt", "e")
    by_dictionary = kept(spark).analyze_text(df, "o", "txt", "e")
    assert by_dictionary.columns == plain.columns
    assert sorted(map(str, by_dictionary.collect())) == sorted(map(str, plain.collect()))


def test_a_second_refresh_judges_no_known_token(spark):
    dictionary, listed = kept(spark), I.listed(rows(spark), "txt")
    tokens = {t for r in listed.collect() for t in r["_tokens"]}
    assert dictionary.refresh(listed, "_tokens") == len(tokens)
    assert dictionary.refresh(listed, "_tokens") == 0 and dictionary.generations() == [0]
    more = spark.createDataFrame([(100, "sal, algo nuevo")], "o bigint, txt string")
    assert dictionary.refresh(I.listed(more, "txt"), "_tokens") == 1
    held = [r["token"] for r in dictionary.read().collect()]
    assert sorted(held) == sorted(tokens | {"algo nuevo"})


def test_an_unfinished_refresh_is_not_read(spark):
    dictionary = kept(spark)
    dictionary.refresh(I.listed(rows(spark), "txt"), "_tokens")
    known = dictionary.read().count()
    dictionary.read().limit(1).drop("gen").write.parquet(f"{dictionary.folder}/tokens/gen=1")
    assert dictionary.read().count() == known


def test_empty_rows(spark):
    assert kept(spark).analyze_text(rows(spark).limit(0), "o", "txt", "e").count() == 0
