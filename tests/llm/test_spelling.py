import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelproof.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    seen = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            low = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if row['doc_id'] is None else row['doc_id']}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            seen[low] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def brute(words):
    out, forms = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(close)
    roots = {}
    for w in words:
        last = w
        while forms[last] is not None:
            last = forms[last]
        roots[w] = last
    return {(w, forms[w], roots[w], n, out[w], words.get(forms[w])) for w, n in words.items()}


def made(spark, words):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rows_equal_brute_force(spark, odd, docs):
    both = odd.unionByName(docs.limit(150)).withColumns({"word": F.lit("clash"), "n": F.lit("clash")})
    assert {tuple(r) for r in spelling.grouped(both).collect()} == brute(counted(both.collect()))


def test_edits_at_every_place_ties_and_chains(spark):
    words = {"colour": 900, "color": 7, "colours": 90, "coloor": 12, "olours": 9, "colou": 5, "coulour": 6, "dolour": 900, "dolours": 30}
    words |= {w: 5 for w in ("aaaaaa", "aaaaaaa", "aaaaaaaa", "aabaaa", "baaaaa", "aaaaab", "ÀÉ×÷ÿa", "àÉ×÷ÿa", "ÀÉ×÷ÿab")}
    docs = made(spark, words)
    assert {tuple(r) for r in spelling.grouped(docs).collect()} == brute(counted(docs.collect()))


def test_words_longer_than_the_levels(spark):
    text = "abcdefghij" * 7
    words = {text[:k]: 5 for k in range(61, 70)}
    words |= {text[:30] + "x" + text[31:k]: 30 for k in (63, 64, 65, 66)} | {text[:20] + text[21:66]: 6, "a" * 64: 5, "a" * 65: 6, "z" * 20_000: 5, "z" * 20_001: 25}
    docs = made(spark, words)
    assert {tuple(r) for r in spelling.grouped(docs).collect()} == brute(counted(docs.collect()))


def test_states_stay_few_for_many_words_of_one_prefix(spark):
    """2000 words that share six letters and are far apart: no word meets all the others."""
    words = spark.range(2000).select(
        F.concat(F.lit("common"), F.translate(F.substring(F.md5(F.col("id").cast("string")), 1, 12), "0123456789", "ghijklmnop")).alias("word"),
        F.lit(5).cast("long").alias("n"),
    )
    read = words.select(F.concat(F.lit(">"), "word").alias("s"), "n")
    met = [spelling.step(read, None, depth).count() for depth in range(10, 19)]
    assert sum(met) < 20 * 2000
    assert spelling.neighbours(words).count() == 0


def test_empty_table_and_a_table_without_words(spark, none):
    assert spelling.grouped(none).count() == 0
    assert spelling.grouped(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("steps", [1, 2, 9, 27])
def test_roots_of_long_chains(spark, steps):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(steps)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {f"w{steps}"}
