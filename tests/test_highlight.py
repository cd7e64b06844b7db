"""Marked pieces of a text."""

import re

from pyspark.sql import functions as F

from labelproof.operators import highlight as H

ROWS = [
    ("Leche, suero de LECHE y lechera; leche", "leche"),
    ("azúcar, Azucar moreno", "azucar"),
    ("a.b y axb", "a.b"),
    ("sal", "leche"),
    ("lechera", "leche"),
    ("sal", None),
    ("sal", " "),
    (None, "sal"),
    ("", "sal"),
]


def _expected(text, term):
    if text is None or not (term or "").strip():
        return [(text, False)]
    plain = text.lower().replace("ú", "u")
    pieces, at = [], 0
    for found in re.finditer(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", plain):
        pieces += [(text[at:found.start()], False), (text[found.start():found.end()], True)]
        at = found.end()
    pieces = [p for p in [*pieces, (text[at:], False)] if p[0] != ""]
    return pieces or [(text, False)]


def test_pieces_against_a_loop(spark):
    df = spark.createDataFrame(ROWS, "t string, m string")
    got = df.select("t", "m", H.trigger_spans(F.col("t"), F.col("m")).alias("s")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert [tuple(p) for p in r.s] == _expected(r.t, r.m), (r.t, r.m)


def test_each_step_stands_once_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, "t string, m string")
    spans = H.trigger_spans(F.col("t"), H.trigger_term(F.concat(F.lit("Contiene "), "m")))
    plan = df.select(spans.alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    # The cut of the text and the search for the term; before, each use repeated them.
    assert plan.count("split(") == 1, plan.count("split(")
    assert plan.count("regexp_extract(") == 1, plan.count("regexp_extract(")
