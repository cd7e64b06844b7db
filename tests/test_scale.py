"""Skew paths and plan shape."""

from pyspark.sql import functions as F

from labelproof.operators import listing as L
from labelproof.operators import quality as Q
from labelproof.operators import reconcile as D
from labelproof.operators import registry as G
from labelproof.operators import review as W
from labelproof.operators.skew import dense_positions


def _products(spark):
    rows = [
        (f"{i:04d}", "Hot" if i % 3 == 0 else f"p{i % 7}", None if i % 3 == 0 else "m",
         ["apto", "vegetariano", "no_apto", "revisar"][i % 4],
         ["ingredientes", "sin_datos", "heuristica"][i % 3], None, "x")
        for i in range(300)
    ]
    return spark.createDataFrame(
        rows,
        "ean string, nombre string, marca string, estado string, fuente_decision string,"
        " confianza double, motivo string",
    )


def test_hot_groups_give_the_same_result(spark):
    df = _products(spark)
    for fn in (D.reconcile_duplicates, W.queue):
        plain = sorted(map(str, fn(df).collect()))
        hot = sorted(map(str, fn(df, hot_keys=2).collect()))
        assert plain == hot


def test_reconcile_is_idempotent(spark):
    once = D.reconcile_duplicates(_products(spark))
    twice = D.reconcile_duplicates(once)
    assert sorted(r.ean + r.estado for r in once.collect()) == sorted(
        r.ean + r.estado for r in twice.collect()
    )


def test_dense_positions_follow_the_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = dense_positions(df, [F.col("v")]).collect()
    assert sorted((r.v, r.pos) for r in rows) == [(i, i) for i in range(1000)]


def test_neighbours_do_not_depend_on_the_chunk(spark):
    df = _products(spark).withColumn("g", F.when(F.col("marca").isNull(), "a").otherwise("b"))
    small = L.neighbours(df, "g", ["nombre"], "ean", chunk=8).collect()
    large = L.neighbours(df, "g", ["nombre"], "ean").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and len(large) == 300 * 6 - 24


def test_streak_cut_against_a_loop(spark):
    rows = [("a" if i < 150 else "b", i, (i * i) % 7 in (1, 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "run string, pos bigint, bad boolean")
    kept = Q.cut_failure_streak(df, "run", "pos", F.col("bad"), streak=2, chunk=10)
    expected, run, done = [], {}, set()
    for name, pos, bad in rows:
        if name in done:
            continue
        expected.append(pos)
        run[name] = run.get(name, 0) + 1 if bad else 0
        if run[name] == 2:
            done.add(name)
    assert sorted(r.pos for r in kept.collect()) == expected


def test_registry_flavour_alone_does_not_match(spark):
    registry = spark.createDataFrame(
        [
            (1, "Doña Magdalena", "Producto dietético a base de coco sabor dulce de leche", "R1"),
            (2, "Felices Las Vacas", "Alimento de almendra, sabor cheddar - Veggie Snacks", "R2"),
        ],
        "id bigint, marca string, producto string, rnpa string",
    )
    products = spark.createDataFrame(
        [("1", "Dulce de leche", "Dona Magdalena"), ("2", "Veggie snacks", "X, Felices las vacas"),
         ("3", "Veggie snacks", None), ("4", "Postre de coco", "Doña Magdalena")],
        "ean string, nombre string, marca string",
    )
    got = G.match(products, G.prepare(registry, "marca", "producto")).collect()
    assert sorted((r.ean, r.id, r.score) for r in got) == [("2", 2, 1.0)]


def test_plans_hold_no_python_and_no_nested_loop(spark):
    import __spark_entry__ as entry_points

    queries = entry_points.queries()
    for name in ("ingredients_verdict", "tags_verdict", "search_ranked", "search_like"):
        plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def _brand_of_many_names(spark, n, entries):
    """One brand whose names and registry texts are made of few common words."""
    words = [f"palabra{chr(97 + k)}" for k in range(24)]

    def text(i, k):
        return " ".join(words[(i * a + b) % len(words)] for a, b in zip((1, 5, 7, 11), (0, k, 3 * k, 7), strict=True))

    names = [(f"{i:06d}", f"{text(i, i // 24 % 13)} {'raro%d' % (i % 97) if i % 3 == 0 else ''}", "Marca") for i in range(n)]
    texts = [(i, "Marca", text(i * 7, i // 24 % 11), f"R{i}") for i in range(entries)]
    products = spark.createDataFrame(names, "ean string, nombre string, marca string")
    return products, G.prepare(spark.createDataFrame(texts, "id bigint, marca string, producto string, rnpa string"), "marca", "producto")


def test_registry_candidates_of_a_large_brand(spark, monkeypatch):
    products, registry = _brand_of_many_names(spark, 10_000, 300)
    named = G.brand_parts(products, "marca").withColumn("_tokens", G.T.token_set(F.col("nombre"))).select("ean", "_place", "_brand", "_tokens")
    sets = G.token_sets(named, registry)
    sizes = {r["lado"]: r["n"] for r in sets.groupBy("lado").agg(F.count("*").alias("n")).collect()}
    pairs = G.candidates(sets)
    seen = pairs.select("_l.id", "_r.id")
    count = seen.count()
    assert count == seen.distinct().count()
    sharing = sizes[0] * sizes[1]
    assert 0 < count < 0.35 * sharing, (count, sharing)
    # A hot token of the brand, dealt out over salts, gives the same pairs.
    before = sorted(map(str, G.match(products.limit(400), registry).collect()))
    monkeypatch.setattr(G, "SALT_ROWS", 5)
    assert sorted(map(str, G.match(products.limit(400), registry).collect())) == before


def test_registry_match_equals_all_pairs(spark):
    products, registry = _brand_of_many_names(spark, 200, 60)
    got = {r["ean"]: (r["id"], r["score"]) for r in G.match(products, registry).collect()}
    rows = products.select("ean", G.T.token_set(F.col("nombre")).alias("t")).collect()
    texts = registry.select("id", "producto_tokens", "sabor_tokens").collect()
    want = {}
    for r in rows:
        best = None
        for e in texts:
            shared = set(r["t"]) & set(e["producto_tokens"])
            small = min(len(r["t"]), len(e["producto_tokens"]))
            if small and len(shared) / small >= G.REGISTRY_OVERLAP and shared - set(e["sabor_tokens"]):
                best = max(best or (0, 0), (len(shared) / small, -e["id"]))
        if best:
            want[r["ean"]] = (-best[1], round(best[0], 2))
    assert {k: (i, round(s, 2)) for k, (i, s) in got.items()} == want


def test_registry_match_reads_few_files(spark):
    import __spark_entry__ as entry_points

    plan = entry_points.queries()["registry_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 6


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_hits_never_broadcast_the_products(spark):
    """The written products look small by their compressed size at any number of rows."""
    from labelproof.operators import search as S

    rows = [(f"{i:013d}", f"leche {i}", "m", None, "apto", None, "ml", None) for i in range(50)]
    products = spark.createDataFrame(
        rows,
        "ean string, nombre string, marca string, categoria string, estado string, cadenas array<string>,"
        " fuente_decision string, ingredients_text string",
    )
    asked = spark.createDataFrame([("a", "leche")], "q_id string, q_texto string")
    hits = S.text_hits(S.search_table(products), asked)
    joins = [line for line in _plan(hits).split("\n") if "Join" in line and "ean#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert hits.count() == 50
