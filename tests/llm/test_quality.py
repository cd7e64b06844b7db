import collections
import re

from pyspark.sql import functions as F

from labelproof.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    places = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, same = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), same, len(places)


def test_counts_equal_brute_force(odd, docs):
    both = odd.unionByName(docs).withColumn("kept", F.lit("clash"))
    rows = quality.measured(both).collect()
    assert len(rows) == both.count()
    for row in rows:
        n = counts(row["text"])
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (row["base_failed"] and row["kept"])


def test_order_changes_cost_but_no_verdict(odd, docs):
    both = quality.prepared(odd.unionByName(docs))
    rules = quality.rules()
    orders = [list(rules), list(rules)[::-1]]
    kept = [sorted(str(r) for r in both.select("doc_id", quality.first_failed(rules, o).isNull().alias("kept")).collect()) for o in orders]
    assert kept[0] == kept[1]


def test_plan_puts_rejections_per_second_first(docs, none):
    plan = quality.plan(docs, sample_rows=50)
    rates = [share / seconds for _, seconds, share in plan]
    assert {p[0] for p in plan} == set(quality.rules()) and rates == sorted(rates, reverse=True)
    assert len(quality.plan(none)) == len(quality.rules()) and quality.cascade(none).count() == 0


def test_cascade_keeps_clean_prose_and_drops_junk(spark):
    clean = " ".join(f"word{i} stands here." for i in range(60))
    junk = [" ".join("thing### is&&&" for _ in range(60)), "Stop Stop " * 60, "\n".join(["one line of words again"] * 40), "1234 5678 " * 60]
    rows = spark.createDataFrame([(0, clean), *((i + 1, t) for i, t in enumerate(junk))], "doc_id long, text string")
    got = {r["doc_id"]: r["failed_rule"] for r in quality.cascade(rows).collect()}
    assert got[0] is None and all(got[i + 1] for i in range(len(junk)))
