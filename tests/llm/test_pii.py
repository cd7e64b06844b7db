import random
import re

from pyspark.sql import functions as F

from labelproof.llm import pii

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_spans_equal_the_patterns():
    random.seed(2)
    for letters in ("0123456789. -", "ab.@-1", "+0123456789 ()-.", "a@b.c+1 2-", "49 .", "٣1.2 é@"):
        for _ in range(4000):
            text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
            assert pii.base_spans(text) == brute(text), repr(text)


def test_rows(spark, odd, none, docs):
    both = odd.unionByName(docs).withColumn("spans", F.lit("clash"))
    model = pii.fit(both)
    for row in pii.found(both, model).collect():
        base = [(s["start"], s["end"], s["kind"]) for s in row["spans"] if s["base"]]
        assert base == brute(row["text"])
    masked = pii.redacted(odd, model)
    assert masked.schema == odd.schema and masked.count() == odd.count() and not pii.base_spans(masked.first()["text"])
    assert pii.found(none, pii.fit(none)).count() == 0


def card(seed):
    random.seed(seed)
    digits = [random.randint(0, 9) for _ in range(15)]
    return next(n for n in ("".join(map(str, [*digits, k])) for k in range(10)) if pii.luhn(n))


def test_repeated_tokens_share_their_label(spark):
    rows = [(i, f"pay with {card(i)} today please or mail me{i}@mail.example.com at {i % 200}.1.2.3 now") for i in range(200)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    # The first one runs into other digits, so the pattern drops it; shape and repetition find it.
    text = f"order 12 {card(900)} and later {card(900)} again"
    kinds = [(text[s:e], k, b) for s, e, k, b in pii.spans(text, model)]
    assert (card(900), "card", True) in kinds and kinds.count((card(900), "card", False)) == 1
    assert pii.spans("in 1999 there were 12 of 40 people, 3.5 each", model) == []


def test_messages_agree_with_exact_marginals_on_a_chain():
    import itertools

    import numpy as np

    random.seed(4)
    size = len(pii.LABELS)
    draw = lambda: [[random.uniform(-1, 1) for _ in range(size)] for _ in range(size)]
    model = pii.Field({}, [random.uniform(-1, 1) for _ in range(size)], draw(), draw())
    text = "1 2 3 4"
    nodes = pii.tokens(text)
    exact = np.zeros((4, size))
    for labels in itertools.product(range(size), repeat=4):
        weight = np.exp(sum(model.bias[y] for y in labels) + sum(model.chain[a][b] for a, b in zip(labels, labels[1:])))
        for i, y in enumerate(labels):
            exact[i, y] += weight
    assert np.allclose(model.beliefs(text, nodes), exact / exact.sum(axis=1, keepdims=True), atol=0.02)


def test_masking():
    model = pii.Field({}, [9.0, 0, 0, 0, 0], [[0] * 5] * 5, [[0] * 5] * 5)
    assert pii.redacted_text("to a.b@c.org or +1 (017) 555-7713.", model) == "to <EMAIL> or <PHONE>."
    assert pii.redacted_text(None, model) is None and pii.redacted_text("", model) == ""
