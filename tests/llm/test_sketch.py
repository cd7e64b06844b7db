import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from labelproof.llm import sketch
from labelproof.llm.tokens import Recent


def brute(rows, size, percent):
    """component per id by all pairs, rows of one id as one node."""
    sets = [(i, sketch.shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def check(spark, rows, size=4, percent=80):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sketch.near_duplicates(frame, size, percent).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, want[i]) for i, _ in rows if i is not None)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def edited(words, share, rng):
    return [w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in words]


def test_groups_equal_all_pairs(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for share in (0.0, 0.005, 0.02, 0.03, 0.06):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(150)]
        for _ in range(14):
            rows.append((n, " ".join(edited(base, share, rng))))
            n += 1
    # Short texts of the same words, a chain whose ends are far apart, and one text held by many.
    rows += [(n + 1, "a b"), (n + 2, "A  B"), (n + 3, "a b c"), (n + 4, "a b c d e"), (n + 5, None), (n + 6, ""), (n + 7, " \n")]
    words = [f"c{i}" for i in range(200)]
    rows += [(n + 10 + k, " ".join(words[6 * k : 6 * k + 100])) for k in range(12)]
    rows += [(n + 30 + k, "the very same text of many words stands here") for k in range(40)]
    rows += [(None, "a b c d e"), (n + 4, "a b c d e"), (n + 4, "a b c d e")]
    rng.shuffle(rows)
    check(spark, rows)


def test_tables_and_odd_rows(spark, docs, odd, none):
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)
    check(spark, [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert sketch.near_duplicates(none).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300, 5000):
        x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        assert (sketch.sketch(x) != 0).all()
    a = rng.integers(1, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(1, 2**63, 100).astype(np.uint64)])
    same = np.mean(sketch.sketch(np.unique(a)) == sketch.sketch(np.unique(b)))
    assert abs(same - 0.8) < 0.12


def test_bands_of_similar_sets_meet():
    rng, missed = random.Random(5), 0
    memory = Recent(xxhash.xxh3_64_intdigest, 1000)
    for n in (5, 30, 120):
        for _ in range(60):
            base = [f"w{rng.randint(0, 10**6)}" for _ in range(n + 3)]
            other = [*base, *(f"v{rng.randint(0, 10**6)}" for _ in range(n // 4))]
            a, b = (set(sketch.bands(sketch.sketch(sketch.hashed_shingles(" ".join(t), 4, memory))).tolist()) for t in (base, other))
            missed += not a & b
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (103, 105), (200, 200)]
    got = {r["node"]: r["component"] for r in sketch.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and got[200] == 200


def test_a_group_of_near_copies_far_from_each_other_makes_no_pairs(spark, monkeypatch):
    """200 near copies of one text, each with words of its own changed: 19,900 possible pairs."""
    rng, written, counts = random.Random(9), sketch.written, {}

    def counting(frame, name):
        kept = written(frame, name)
        counts[name] = counts.get(name, 0) + kept.count()
        return kept

    monkeypatch.setattr(sketch, "written", counting)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(5, 195), 3 + i % 6):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    check(spark, rows)
    print(counts)
    assert counts.get("pairs", 0) < 200 and counts.get("meetings", 0) < 20 * 200 and counts.get("under", 0) < 20 * 200, counts


def test_links_between_members_that_only_share_edits(spark, monkeypatch):
    """Chains and groups of their own inside one large group, with common edits."""
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(120)], []
    for group in range(6):
        common = list(base)
        for at in rng.sample(range(5, 115), 5):
            common[at] = f"g{group}x{at}"
        for i in range(12):
            words = list(common)
            for at in rng.sample(range(5, 115), 1 + i % 3):
                words[at] = f"own{group}x{i}x{at}"
            rows.append((group * 100 + i, " ".join(words)))
    check(spark, rows)
    monkeypatch.setattr(sketch, "HOT", 2)
    check(spark, rows)
