"""The recursive walk, the page directory and merged streak summaries."""

import random

import pytest
from pyspark.sql import functions as F

from labelproof.operators import listing, quality

NODES = "id long, parent long, total long, leaf boolean, raiz boolean"


def test_a_deep_tree_and_a_root_inside_a_cycle(spark):
    deep = [(i, i - 1 if i else None, 1000, False, i == 0) for i in range(150)] + [(150, 149, 7, True, False)]
    cycle = [(500, 502, 900, False, True), (501, 500, 900, False, False), (502, 501, 900, False, False), (503, 502, 3, True, False)]
    nodes = spark.createDataFrame(deep + cycle, NODES)
    walk = listing.drill_down(nodes, F.lit(50))
    assert sorted(map(tuple, walk.collect())) == [(150, 7), (503, 3)]
    assert "UnionLoop" in walk._jdf.queryExecution().executedPlan().toString()


def test_no_root_and_no_rows(spark):
    nodes = spark.createDataFrame([(1, None, 5, True, False)], NODES)
    assert listing.drill_down(nodes, F.lit(50)).count() == 0 and listing.drill_down(nodes.limit(0), F.lit(50)).count() == 0


def test_pages_of_a_directory_read_their_ranges_only(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("t"))
    kept = listing.PageDirectory(rows, [F.col("v")], 24, ranges=16)
    assert kept.page_count() == 209 and kept.total == 5000 and len(kept.lines) == 16
    for number in (1, 2, 100, 209):
        assert [r["v"] for r in kept.page(number).collect()] == list(range((number - 1) * 24, min(number * 24, 5000)))
    assert kept.page(210).count() == 0
    # A page inside one range reads one folder.
    plan = kept.page(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_rango" in plan and " IN (" not in plan.split("PartitionFilters")[1].split("]")[0]


def test_pages_of_ties_and_of_nothing(spark):
    ties = spark.range(0, 100).select(F.lit("same").alias("v"), "id")
    kept = listing.PageDirectory(ties, [F.col("v"), F.col("id")], 10, ranges=4)
    assert [r["id"] for n in range(1, 11) for r in kept.page(n).collect()] == list(range(100))
    none = listing.PageDirectory(ties.limit(0), [F.col("v"), F.col("id")], 10, ranges=4)
    assert none.page_count() == 1 and none.page(1).count() == 0


def first_cut(flags, streak):
    run = 0
    for i, bad in enumerate(flags):
        run = run + 1 if bad else 0
        if run == streak:
            return i + 1
    return len(flags)


@pytest.mark.parametrize("chunk", [1, 2, 5, 13, 1000])
def test_streaks_over_many_chunks_equal_a_loop(spark, chunk):
    rng = random.Random(chunk)
    runs = {f"r{k}": [rng.random() < share for _ in range(n)] for k, (share, n) in enumerate([(0.5, 60), (0.9, 80), (1.0, 37), (0.0, 20), (0.7, 1), (0.95, 200)])}
    log = spark.createDataFrame([(r, 3 * i, b) for r, flags in runs.items() for i, b in enumerate(flags)], "run string, pos long, bad boolean")
    for streak in (1, 3, 12):
        kept = quality.cut_failure_streak(log, "run", "pos", F.col("bad"), streak=streak, chunk=chunk)
        got = {r["run"]: r["count"] for r in kept.groupBy("run").count().collect()}
        assert got == {r: first_cut(flags, streak) for r, flags in runs.items()}
