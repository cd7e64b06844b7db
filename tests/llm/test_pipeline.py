import corpus_pipeline
from labelproof.llm import bpe, pii, queries, sketch
from labelproof.llm.common import written
from labelproof.llm.tokens import Pieces, vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_their_promises(spark, docs):
    rows, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = written(stage(spark, rows, FOLDER), f"test-{name}")
        if name != "bpe":
            assert rows.columns == docs.columns
        kept[name] = rows
    texts = {r["doc_id"]: r["text"] for r in kept["near_duplicates"].collect()}
    sets = {i: sketch.shingles(t, 5) for i, t in texts.items()}
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j)
    assert len(texts) < kept["toxicity"].count() <= docs.count()
    masked = kept["personal_data"].collect()
    assert len(masked) == kept["decontamination"].count() and all(r["n_chars"] == len(r["text"]) for r in masked)
    assert not any(pii.base_spans(r["text"]) for r in masked)
    encoder = Pieces(vocabulary("word_bpe_49k.json"))
    ids = {r["doc_id"]: r["ids"] for r in rows.collect()}
    assert ids == {r["doc_id"]: encoder.tokenizer.encode(r["text"], add_special_tokens=False).ids for r in masked}
    assert before.count() == rows.count() and bpe.MEAN_CHUNK


def test_odd_and_empty_tables_pass(spark, odd, none):
    for rows in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, FOLDER), f"test-{name}")
        assert rows.count() <= 9


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.CHECKS) <= set(queries.QUERIES)


def test_rows_without_or_with_repeated_ids_stand_for_themselves(spark, docs):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    texts = [(None, item), (None, "clean words of one row"), (None, "clean words of another"), (3, "one text of id three"), (3, "quite another text under it"), (3, "one text of id three"), (4, item), (4, "a clean row of id four")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], docs.schema)
    left = corpus_pipeline.drop_copies(spark, rows, FOLDER)
    assert sorted(r["text"] for r in left.filter("doc_id is not null").collect()) == sorted({t for i, t in texts if i})
    clean = corpus_pipeline.drop_benchmark(spark, rows, FOLDER)
    assert clean.columns == docs.columns
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in texts if t != item)
