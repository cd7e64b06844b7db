"""The posting table against plain loops: build, deltas, pruning, unfinished writes."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from labelproof.operators.postings import Index, forward, plain_words
from labelproof.operators.skew import shared_folder

DOCS = "doc string, nombre string, marca string"
FIRST = [
    ("a", "Leche de coco", "Vaca"), ("b", "LECHE  entera leche", None), ("c", None, "coco"), ("d", "", ""), ("e", "Cacao; dulce-de leche", "Leche"),
    ("f", "ñandú 7up", "Ñandú"),
]


def index(spark, rows, fields=("nombre", "marca")):
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    return Index(spark, folder, list(fields)).build(spark.createDataFrame(rows, DOCS))


def words(*texts):
    fold = str.maketrans("áéíóúüñ", "aeiouun")
    return [w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower().translate(fold))]


def expected(rows, prefixes):
    return sorted(d for d, n, m in rows if all(any(w.startswith(p) for w in words(n, m)) for p in prefixes))


def found(spark, ix, text):
    hits = ix.search(spark.createDataFrame([("q", text)], "q_id string, q_texto string"), 100)
    return sorted(r["doc"] for r in hits.collect())


def test_forward_counts_words_by_field(spark):
    rows = {r["doc"]: r for r in forward(spark.createDataFrame(FIRST, DOCS), ["nombre", "marca"]).collect()}
    got = {(w["palabra"], w["campo"], w["tf"], w["primero"]) for w in rows["e"]["palabras"]}
    assert got == {("cacao", 0, 1, True), ("de", 0, 1, True), ("dulce", 0, 1, True), ("leche", 0, 1, True), ("leche", 1, 1, False)}
    assert {(w["palabra"], w["tf"]) for w in rows["b"]["palabras"]} == {("leche", 2), ("entera", 1)} and rows["b"]["largo"] == 3
    assert rows["d"]["largo"] == 0 and rows["d"]["palabras"] == []


@pytest.mark.parametrize("text", ["leche", "lec co", "c", "coco vaca", "LÉCHE", "nada", "", "7", "de l"])
def test_search_equals_a_loop(spark, text):
    ix = index(spark, FIRST)
    assert found(spark, ix, text) == (expected(FIRST, words(text)) if words(text) else [])


def test_deltas_equal_a_rebuild(spark):
    ix = index(spark, FIRST)
    ix.apply(spark.createDataFrame([("a", "agua", "Vaca"), ("g", "leche nueva", None)], DOCS), spark.createDataFrame([("b",)], "doc string"))
    ix.apply(spark.createDataFrame([("a", "leche otra vez", None), ("b", "leche de vuelta", "x")], DOCS))
    now = [("a", "leche otra vez", None), ("b", "leche de vuelta", "x"), *FIRST[2:], ("g", "leche nueva", None)]
    again = index(spark, now)
    assert list(map(tuple, ix.vocabulary().collect())) == list(map(tuple, again.vocabulary().collect()))
    asked = spark.createDataFrame([(q, q) for q in ("leche", "co", "de", "agua", "n")], "q_id string, q_texto string")
    assert sorted(map(str, ix.search(asked, 10).collect())) == sorted(map(str, again.search(asked, 10).collect()))


def test_a_search_reads_the_parts_of_its_words_only(spark):
    rows = [(f"{i:05d}", f"w{i:05d} comun", "m") for i in range(4000)]
    ix = index(spark, rows)
    wanted = ix.wanted(spark.createDataFrame([("w00012",)], "prefijo string"))
    read = ix.postings(wanted)
    parts = [r["parte"] for r in wanted.select("parte").collect()]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert len(parts) == 1 and re.search(rf"PartitionFilters: \[[^]]*parte#\d+ = {parts[0]}\)", plan), plan
    assert [r["doc"] for r in read.collect()] == ["00012"]
    # The most common word is spread over several parts instead of one.
    assert ix.wanted(spark.createDataFrame([("comun",)], "prefijo string")).select("parte").distinct().count() > 1


def test_a_generation_without_its_line_in_the_log_is_not_read(spark):
    ix = index(spark, FIRST)
    before = found(spark, ix, "leche")
    ix._write(forward(spark.createDataFrame([("z", "leche", None)], DOCS), ix.fields), "docs", 1)
    assert ix.generations() == [0] and found(spark, ix, "leche") == before
    ix.apply(spark.createDataFrame([("y", "leche", None)], DOCS))
    assert found(spark, ix, "leche") == sorted([*before, "y"])


def test_words_are_folded_runs_of_letters_and_digits(spark):
    row = spark.createDataFrame([("  Café-CON  leche_2%",)], "t string").select(plain_words(F.col("t")).alias("w")).first()
    assert row["w"] == ["cafe", "con", "leche", "2"]


def test_empty_index(spark):
    ix = index(spark, [])
    assert found(spark, ix, "leche") == [] and ix.vocabulary().count() == 0


def test_hits_meet_by_document_before_they_meet_queries(spark):
    """Queries with common words repeat no hit in a shuffle."""
    docs = spark.createDataFrame([(str(i), f"leche de coco {i % 7} sal") for i in range(3000)], "doc string, texto string")
    asked = spark.createDataFrame([(f"q{i}", "leche co sal") for i in range(5)], "q_id string, q_texto string")
    ix = Index(spark, f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", ["texto"]).build(docs)
    hits = ix.search(asked, 20)
    assert len(hits.collect()) == 5 * 20
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(q_id#\d+, doc#", plan) and re.search(r"hashpartitioning\(doc#", plan)
