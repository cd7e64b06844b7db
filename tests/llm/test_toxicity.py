import random

import pytest
from pyspark.sql import functions as F

from labelproof.llm import toxicity
from labelproof.llm.common import held_out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_edit_distance():
    terms = [("idiot", False), ("scum", False), ("worthless", False), ("lowei", True), ("pathetic", True)]
    automaton, rng = toxicity.Automaton(terms), random.Random(1)
    for _ in range(6000):
        term, prefix = rng.choice(terms)
        word = list(term + (rng.choice(["", "s", "xyz"]) if prefix else ""))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(word))
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "o", "s"])
        word = "".join(word)
        best = []
        for t, p in terms:
            options = [word[:k] for k in range(len(word) + 1)] if p else [word]
            d = min(distance(o, t) for o in options)
            if d <= toxicity.allowed(t, p):
                best.append(d)
        hit = automaton.find(word)
        assert (hit[1] if hit else None) == (min(best) if best else None), word


def test_quotation_weighs_less():
    found = toxicity.Found(toxicity.Automaton([("idiot", False)]))
    plain, hits = toxicity.features("you are an idiot and you know it", found)
    quoted, _ = toxicity.features('she wrote "you are an idiot" in the letter', found)
    assert len(hits) == 1 and quoted[0] < plain[0] and toxicity.features("you idi0t", found)[0][1] > 0
    assert toxicity.features(None, found) == ([0.0] * 3, []) and toxicity.features("", found) == ([0.0] * 3, [])


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_rows(fitted):
    docs, labels, model = fitted
    rows = toxicity.scored(docs.filter(held_out(F.col("doc_id"))).withColumn("score", F.lit("clash")), model).join(labels, "doc_id")
    told = {(r["toxic"], r["p"]): r["count"] for r in rows.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).count().collect()}
    assert told[1, True] >= 0.8 * (told[1, True] + told[1, False]) and told.get((0, True), 0) <= 0.02 * told[0, False]


def test_odd_rows(spark, fitted, odd, none):
    docs, labels, model = fitted
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] < 0.3 for r in rows)
    assert toxicity.scored(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert blank.terms == [] and blank.score([0.0, 0.0, 0.0]) < 0.01
    null_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(odd, null_labels).terms == []
