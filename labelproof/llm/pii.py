"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field works on the tokens that hold a digit or an at sign:
neighbours are joined in a chain, and each token to the next one of the same text or the same
kind of address in the document, however far (skip edges, two per token at most, so a document
has linearly many). Node weights are a multinomial logistic model over shapes and neighbours,
edge weights come from counts; both are fitted on at most `SAMPLE` documents whose base spans
serve as labels. Loopy belief propagation passes messages along both kinds of edges; a run of
tokens that the patterns left out becomes a span where every token's belief in one kind reaches
`SURE`. Thus a card number that ran into its neighbour and so failed the pattern is found by
its shape and by its other occurrences. Base spans always stay.

Defined results: null and empty texts have no spans; spans count code points, end exclusive;
repeated rows get the same spans each; other columns pass through, the new one is replaced. All
work is local to a row and linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
SURE = 0.95
ROUNDS = 12
NEAR = 24  # characters between neighbours of the chain
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: only an at sign can end the local part, so matching starts from there."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_SET:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, per kind leftmost and without overlap."""
    if not text or not TELLING.search(text):
        return []
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    for m in DOTTED.finditer(text):
        # Four parts at a time from the left of a dotted run of digits.
        parts = list(re.finditer("[0-9]+", m.group())) if m.group().count(".") >= 3 else []
        for k in range(0, len(parts) - 3, 4):
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group()) <= 255 for p in parts[k : k + 4]):
                out.append((m.start() + parts[k].start(), m.start() + parts[k + 3].end(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an at sign, without the signs around them."""
    out, end = [], 0
    for m in TELLING.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        low, high = start, end
        while low < high and not (text[low].isalnum() or text[low] in "+("):
            low += 1
        while high > low and not (text[high - 1].isalnum() or text[high - 1] == ")"):
            high -= 1
        if low < high:
            out.append((low, high))
    return out


def _shape(word: str) -> str:
    """Digits as 9, letters as a, runs by their length up to 20; other signs as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word[:200], re.S):
        c = m.group()
        out.append(f"9{min(len(c), 20)}" if c[0].isdigit() else "a" if c[0].isalpha() else c)
    return "".join(out)[:80]


def node_features(text: str, start: int, end: int) -> tuple[str, ...]:
    word = text[start:end]
    before, after = text[max(0, start - NEAR) : start].split(), text[end : end + NEAR].split()
    return (
        "shape=" + _shape(word),
        "kinds=" + re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word[:200])))[:40],
        f"digits={min(sum(c.isdigit() for c in word), 20)}",
        "before=" + (_shape(before[-1]) if before else ""),
        "after=" + (_shape(after[0]) if after else ""),
    )


def edges(text: str, nodes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between near neighbours; skip edges to the next equal or similar token."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    skip, seen = [], {}
    near = set(chain)
    for i, (start, end) in enumerate(nodes):
        word = text[start:end].lower()
        similar = {word, "@" + word.partition("@")[2]} if "@" in word else {word}
        for key in similar:
            j = seen.get(key)
            if j is not None and (j, i) not in near:
                skip.append((j, i))
            seen[key] = i
    return chain, sorted(set(skip))


@dataclass
class Field:
    """Weights: feature -> one per label; log potentials of the two kinds of edges."""

    nodes: dict[str, list[float]]
    bias: list[float]
    chain: list[list[float]]
    skip: list[list[float]]

    def beliefs(self, text: str, nodes: list[tuple[int, int]]) -> np.ndarray:
        """Marginals per node by loopy sum-product."""
        zero = [0.0] * len(LABELS)
        own = np.array(self.bias) + np.array(
            [np.sum([self.nodes.get(f, zero) for f in node_features(text, s, e)], axis=0) for s, e in nodes]
        )
        chain, skip = edges(text, nodes)
        if not chain and not skip:
            return _softmax(own)
        pairs = np.array([*chain, *skip])
        weight = np.array([self.chain] * len(chain) + [self.skip] * len(skip))
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(source)), len(pairs))
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + weight
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if moved < 1e-4:
                break
        total = own.copy()
        np.add.at(total, target, message)
        return _softmax(total)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _labels(nodes: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[int]:
    """The label of each token by the base spans that overlap it."""
    out, k = [], 0
    for start, end in nodes:
        while k < len(base) and base[k][1] <= start and (k + 1 < len(base) and base[k + 1][0] <= start):
            k += 1
        hit = next((b for b in base[k : k + 4] if b[0] < end and b[1] > start), None)
        out.append(LABELS.index(hit[2]) if hit else 0)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Node and edge weights from the base spans of at most `sample` documents, by lowest id hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ids = rows.filter(F.col("text").rlike("[0-9@]")).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = rows.join(F.broadcast(ids.distinct()), "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what, first, second, features = [], [], [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                nodes = tokens(text)
                label = _labels(nodes, base_spans(text))
                for (s, e), y in zip(nodes, label, strict=True):
                    what.append("node"), first.append(y), second.append(0), features.append(node_features(text, s, e))
                for name, found in zip(("chain", "skip"), edges(text, nodes), strict=True):
                    for i, j in found:
                        what.append(name), first.append(label[i]), second.append(label[j]), features.append(())
            yield pa.RecordBatch.from_arrays(
                [pa.array(what, pa.string()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(features, pa.list_(pa.string()))],
                ["what", "first", "second", "features"],
            )

    counted = rows.mapInArrow(run, "what string, first int, second int, features array<string>")
    drawn = counted.groupBy("what", "first", "second", "features").count().collect()
    size = len(LABELS)
    ties = {"chain": np.full((size, size), 0.5), "skip": np.full((size, size), 0.5) + np.eye(size)}
    number: dict[str, int] = {}
    x, y, n = [], [], []
    for row in sorted(drawn, key=lambda r: (r["what"], r["features"], r["first"], r["second"])):
        if row["what"] == "node":
            x.append([number.setdefault(f, len(number)) for f in row["features"]])
            y.append(row["first"])
            n.append(row["count"])
        else:
            ties[row["what"]][row["first"], row["second"]] += row["count"]
    pmi = {k: np.clip(np.log(c * c.sum() / np.outer(c.sum(axis=1), c.sum(axis=0))), -3, 3) for k, c in ties.items()}
    weights, bias = _multinomial(np.array(x, int).reshape(len(y), 5), np.array(y, int), np.array(n, float), len(number))
    return Field({f: weights[i].tolist() for f, i in number.items()}, bias.tolist(), pmi["chain"].tolist(), pmi["skip"].tolist())


def _multinomial(x: np.ndarray, y: np.ndarray, n: np.ndarray, features: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic weights by adaptive gradient steps with a small penalty."""
    w, bias = np.zeros((features, len(LABELS))), np.zeros(len(LABELS))
    if not len(y):
        bias[0] = 10.0
        return w, bias
    target = np.eye(len(LABELS))[y]
    speed, speed_bias = np.full_like(w, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(steps):
        p = _softmax(w[x].sum(axis=1) + bias)
        slope = (p - target) * n[:, None]
        gradient = 0.05 * w
        for k in range(x.shape[1]):
            np.add.at(gradient, x[:, k], slope)
        speed += gradient**2
        speed_bias += slope.sum(axis=0) ** 2
        w -= 0.5 * gradient / np.sqrt(speed)
        bias -= 0.5 * slope.sum(axis=0) / np.sqrt(speed_bias)
    return w, bias


def spans(text: str | None, model: Field) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, is base) of all spans, by start, then kind."""
    base = base_spans(text)
    out = [(s, e, k, True) for s, e, k in base]
    nodes = tokens(text) if text and TELLING.search(text) else []
    if nodes:
        p = model.beliefs(text, nodes)
        best = p.argmax(axis=1)
        covered = np.array([y > 0 for y in _labels(nodes, base)])
        wanted = (best > 0) & (p.max(axis=1) >= SURE) & ~covered
        i = 0
        while i < len(nodes):
            j = i + 1
            if wanted[i]:
                while j < len(nodes) and wanted[j] and best[j] == best[i] == 4 and nodes[j][0] - nodes[j - 1][1] <= 1:
                    j += 1
                out.append((nodes[i][0], nodes[j - 1][1], LABELS[best[i]], False))
            i = j
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def found(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """`docs` with `spans`: kind, start, end and whether a pattern gave it."""
    kept = [f for f in docs.schema if f.name != "spans"]
    schema = T.StructType([*kept, T.StructField("spans", T._parse_datatype_string(SPAN), False)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in spans(t.as_py(), model)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "spans"])

    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)


def redacted_text(text: str | None, model: Field) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans(text, model):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """`docs` with personal data masked in its text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = pa.array([redacted_text(t.as_py(), model) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
