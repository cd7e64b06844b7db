import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from labelproof.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """Per row the set of letters it fails."""
    out = []
    for row in rows:
        text = row["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if row["doc_id"] is not None and any(
            o["doc_id"] is not None and o["doc_id"] < row["doc_id"] and (o["text"] or "") == text for o in rows
        ):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    good = {r[0] for r in labels if r[1] == 1} - {None}
    toxic = {r[0] for r in labels if r[2] == 1} - {None}
    bits = fails(rows)
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {r["source"] or "" for r in rows}:
            left = [(r, b) for r, b in zip(rows, bits, strict=True) if (r["source"] or "") == part]
            whole = left
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = sum(letter in b for _, b in whole)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(b == {letter} for _, b in whole),
                    sum(r["doc_id"] in good for r, _ in gone), sum(r["doc_id"] in toxic for r, _ in gone),
                ]
                shares[part, letter] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_figures_equal_brute_force(spark, odd, docs):
    extra = spark.createDataFrame(
        [
            (90, "", "en", "s", 0), (91, None, "en", None, None), (92, "SAME # TEXT", "en", "", 3), (93, "SAME # TEXT", "en", "t", 3),
            (94, "SAME # TEXT", "en", None, 3), (None, "SAME # TEXT", "en", "t", 3), (93, "SAME # TEXT", "en", "t", 3),
        ],
        odd.schema,
    )
    both = odd.unionByName(extra).unionByName(docs.limit(60))
    labels = [(92, 1, 1), (93, 1, 0), (93, 0, 1), (None, 1, 1), (5, 1, None), (94, None, 1)]
    rows = both.collect()
    got = filter_audit.audited(both.withColumns({"bits": F.lit("clash"), "rows": F.lit("clash")}), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({r["source"] or "" for r in rows})
    for r in got:
        assert tuple(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r


def test_contraction_counts_each_row_of_a_random_tensor():
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 32))
    got = filter_audit.contracted(counts)
    for k, (order, step) in enumerate(itertools.product(filter_audit.ORDERS, range(5))):
        bit = {f: 16 >> i for i, f in enumerate("ABCDE")}
        before, own = sum(bit[f] for f in order[:step]), bit[order[step]]
        for part in range(2):
            cells = counts[part, 0]
            assert got["kept"][part, k] == sum(cells[c] for c in range(32) if not c & (before | own))
            assert got["redundant"][part, k] == sum(cells[c] for c in range(32) if c & before and c & own)
            assert got["good_lost"][part, k] == sum(counts[part, 1, c] for c in range(32) if not c & before and c & own)


def test_a_part_that_loses_nothing_still_has_all_its_rows(spark):
    clean = " ".join(f"w{i}" for i in range(250))
    rows = filter_audit.audited(spark.createDataFrame([(1, clean, "a")], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 and all(r["kept"] == 1 and r["removed"] == 0 == r["shapley"] for r in rows)


def test_empty_table(spark, none):
    assert filter_audit.audited(none, spark.createDataFrame([], LABELS)).count() == 0
