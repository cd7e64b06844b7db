"""Toxicity by a learned lexicon, a Levenshtein automaton and context windows.

Learning. From at most `SAMPLE` labelled rows outside the held-out split (lowest hashes of the
id; one row per family of near copies, so that copies don't vote often) Spark counts, for every
word and word prefix, the toxic and the clean texts that hold it. A term enters the lexicon if
chance hardly explains its share of toxic texts; of a chain of prefixes the longest that keeps
the support is taken, so inflected stems become prefix terms and single words whole terms.

Matching. The terms form a trie. The automaton of all strings within a term's edit distance runs
over it as sets of (node, edits), made deterministic lazily: a step is a lookup once seen, and
most words die after a few letters. Distances a term shows mostly in clean training texts are
left out. A hit counts in its context window: inside quotation marks or beside words that report
speech it weighs `QUOTED`, else 1; hits close together add a density. A logistic model over
these sums, fitted on the same bounded sample, gives the score.

Defined results: null, empty and wordless texts get the score of a text without hits; null
labels aren't learned from; without any labelled row the lexicon is empty and the score 0;
repeated rows get one score each; other columns pass through, `score` is replaced if present.
Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.llm.common import held_out, written

SAMPLE = 12_000
SHORTEST_PREFIX, LONGEST_PREFIX = 4, 14
CERTAIN = 6.5  # decimal digits by which chance is unlikely
PRECISION = 0.9
WINDOW = 10  # words on each side of a hit
QUOTED = 0.25
TOKEN = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”„«»‹›‘’]|(?<!\\w)'|'(?!\\w)")
REPORTING = frozenset("said says say wrote called calls quoted quote quotes word words term terms means mean meaning".split())


def allowed(term: str, prefix: bool) -> int:
    """Edits within which a misspelling still counts as the term."""
    if prefix:
        return 0 if len(term) < 8 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Automaton:
    """Levenshtein automaton over the trie of the terms; `find` gives (term, edits) or None."""

    terms: list[tuple[str, bool]]  # the term, and whether any word that it begins counts
    banned: frozenset = frozenset()  # (term number, edits) that don't count
    nodes: list[dict] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    most: list[int] = field(default_factory=lambda: [0])
    steps: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for number, (term, prefix) in enumerate(self.terms):
            node, path = 0, [0]
            for c in term:
                if c not in self.nodes[node]:
                    self.nodes[node][c] = len(self.nodes)
                    self.nodes.append({})
                    self.most.append(0)
                node = self.nodes[node][c]
                path.append(node)
            self.ends[node] = number
            for n in path:
                self.most[n] = max(self.most[n], allowed(term, prefix))
        self.start = self._closed({0: 0})

    def _closed(self, at: dict[int, int]) -> frozenset:
        """With the letters that the word may lack."""
        todo = list(at.items())
        while todo:
            node, edits = todo.pop()
            for child in self.nodes[node].values():
                if edits + 1 <= self.most[child] and edits + 1 < at.get(child, 99):
                    at[child] = edits + 1
                    todo.append((child, edits + 1))
        return frozenset(at.items())

    def _step(self, state: frozenset, c: str) -> tuple[frozenset, tuple | None]:
        at: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.most[node] and edits < at.get(node, 99):
                at[node] = edits

        for node, edits in state:
            put(node, edits + 1)
            for letter, child in self.nodes[node].items():
                put(child, edits + (letter != c))
        closed = self._closed(at)
        return closed, self._hit(closed, True)

    def _hit(self, state: frozenset, prefix: bool) -> tuple[int, int] | None:
        hits = [
            (edits, self.ends[node]) for node, edits in state
            if node in self.ends and self.terms[self.ends[node]][1] == prefix
            and edits <= allowed(*self.terms[self.ends[node]]) and (self.ends[node], edits) not in self.banned
        ]
        return min(hits)[::-1] if hits else None

    def find(self, word: str) -> tuple[int, int] | None:
        state, best, steps = self.start, None, self.steps
        if len(steps) > 50_000:
            steps.clear()
        for c in word:
            step = steps.get((state, c))
            if step is None:
                step = steps[state, c] = self._step(state, c)
            state, hit = step
            if hit and (best is None or hit[1] < best[1]):
                best = hit
            if not state:
                break
        else:
            hit = self._hit(state, False)
            if hit and (best is None or hit[1] < best[1]):
                best = hit
        return best


class Found(dict):
    """Word -> hit, remembered up to a bound."""

    def __init__(self, automaton: Automaton, limit: int = 200_000):
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        hit = self[word] = self.automaton.find(word)
        return hit


def features(text: str | None, found: Found) -> tuple[list[float], list[tuple[int, int]]]:
    """Sums over the hits of a text, weighed by context, and the hits themselves."""
    if not text:
        return [0.0, 0.0, 0.0], []
    words = TOKEN.findall(text.lower())
    hits = [(i, h) for i, h in enumerate(map(found.__getitem__, words)) if h]
    if not hits:
        return [0.0, 0.0, 0.0], []
    quoted = _quoted(text.lower(), {i for i, _ in hits})
    exact = near = 0.0
    weights = []
    for i, (_, edits) in hits:
        window = words[max(0, i - WINDOW) : i + WINDOW + 1]
        weight = QUOTED if i in quoted or not REPORTING.isdisjoint(window) else 1.0
        weights.append(weight)
        if edits:
            near += weight
        else:
            exact += weight
    dense, low, inside = 0.0, 0, 0.0
    for high, (i, _) in enumerate(hits):
        inside += weights[high]
        while hits[low][0] < i - 2 * WINDOW:
            inside -= weights[low]
            low += 1
        dense = max(dense, inside)
    return [math.log1p(exact), math.log1p(near), math.log1p(dense)], [h for _, h in hits]


def _quoted(text: str, at: set[int]) -> set[int]:
    """Hits between an odd and the next quotation mark of their line, at most a window away."""
    marks = [m.start() for m in QUOTES.finditer(text)]
    if not marks:
        return set()
    marks = np.array(marks)
    breaks = np.array([m.start() for m in re.finditer("\n", text)])
    out = set()
    for i, m in enumerate(TOKEN.finditer(text)):
        if i not in at:
            continue
        line = int(breaks[np.searchsorted(breaks, m.start()) - 1]) if np.searchsorted(breaks, m.start()) else -1
        before = marks[np.searchsorted(marks, line, "right") : np.searchsorted(marks, m.start())]
        after = np.searchsorted(marks, m.end() - 1)
        near = after < len(marks) and marks[after] - m.end() < 12 * WINDOW
        if len(before) % 2 and near:
            out.add(i)
    return out


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    banned: frozenset
    weights: list[float]  # bias first

    def score(self, sums: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], sums, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` training rows (text, toxic), one per family of near copies."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("words", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))
    near = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    return rows.select(
        "doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.array_min(near).alias("family")
    ).dropDuplicates(["family", "toxic"])


def lexicon(rows: DataFrame) -> list[tuple[str, bool]]:
    """Terms whose presence means toxicity: whole words, or prefixes of three words and more."""
    base = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not base["n"] or not base["toxic"] or base["toxic"] == base["n"]:
        return []
    share = base["toxic"] / base["n"]
    word = F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+', 0)")))
    words = rows.select("doc_id", "toxic", word.alias("word"))
    prefixes = F.transform(
        F.sequence(F.lit(SHORTEST_PREFIX), F.least(F.length("word"), F.lit(LONGEST_PREFIX))), lambda n: F.substring("word", F.lit(1), n)
    )
    prefixes = F.when(F.length("word") >= SHORTEST_PREFIX, prefixes).otherwise(F.array().cast("array<string>"))
    parts = words.select("doc_id", "toxic", F.explode(F.concat(prefixes, F.array(F.concat("word", F.lit("$"))))).alias("term")).distinct()
    counted = parts.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    # Chernoff's bound on that many toxic texts among n by chance, as decimal digits.
    p = F.col("toxic") / F.col("n")
    unlikely = F.col("n") * (p * F.log10(p / share) + F.when(p < 1, (1 - p) * F.log10((1 - p) / (1 - share))).otherwise(0.0))
    strong = counted.filter((p >= PRECISION) & (unlikely >= CERTAIN)).select("term", "toxic").collect()
    support = {r["term"]: r["toxic"] for r in strong}
    whole = {t[:-1]: n for t, n in support.items() if t.endswith("$")}
    stems = {t: n for t, n in support.items() if not t.endswith("$")}
    chosen: dict[str, bool] = {}
    for stem, n in sorted(stems.items(), key=lambda x: len(x[0])):
        if any(stem[:k] in chosen and chosen[stem[:k]] for k in range(SHORTEST_PREFIX, len(stem))):
            continue
        if whole.get(stem, 0) >= 0.9 * n:
            chosen[stem] = False
        elif not any(len(s) == len(stem) + 1 and s.startswith(stem) and m >= 0.95 * n for s, m in stems.items()):
            chosen[stem] = True
    for term in whole:
        if term not in chosen and not any(chosen.get(term[:k]) for k in range(SHORTEST_PREFIX, len(term))):
            chosen[term] = False
    return sorted(chosen.items())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, banned misspellings and weights from a bounded labelled sample."""
    rows = written(labelled(docs, labels, sample), "toxicity-sample")
    terms = lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(Automaton(terms))
        for batch in batches:
            names = ["toxic", "hits", "text"]
            hits = [sorted({n * 10 + e for n, e in features(t.as_py(), found)[1]}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int64())), batch.column(1)], names)

    # Which misspellings of which term stand in clean texts?
    seen = (
        rows.select("toxic", "text").mapInArrow(run, "toxic int, hits array<long>, text string")
        .select("toxic", F.explode("hits").alias("hit")).groupBy("hit").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    )
    banned = frozenset((r["hit"] // 10, r["hit"] % 10) for r in seen if r["hit"] % 10 and r["toxic"] < 0.8 * r["n"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(Automaton(terms, banned))
        for batch in batches:
            x = [features(t.as_py(), found)[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    # At most `sample` rows of three numbers, counted by value first.
    drawn = rows.select("toxic", "text").mapInArrow(sums, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    if not drawn:
        return Model(terms, banned, [-30.0, 0.0, 0.0, 0.0])
    x = np.array([[1.0, *r["x"]] for r in drawn])
    y, n = np.array([r["toxic"] for r in drawn], float), np.array([r["count"] for r in drawn], float)
    return Model(terms, banned, _logistic(x, y, n).tolist())


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Penalised logistic regression by Newton's method, the sums' weights kept from falling below zero."""
    w, held = np.zeros(x.shape[1]), np.zeros(x.shape[1], bool)
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge @ w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        free = ~held
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        w = w - np.clip(step, -2, 2)
        held[1:] |= w[1:] < 0
        w[held] = 0.0
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `score`, 0 to 1."""
    kept = [f for f in docs.schema if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(Automaton(model.terms, model.banned))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            score = [model.score(features(t.as_py(), found)[0]) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])

    return docs.select(*(f.name for f in kept)).mapInArrow(run, schema)
