"""Main text of web pages: boosted trees over DOM nodes and a decoding that agrees along the tree.

A small tolerant parser gives block-level nodes and their runs of text. Every node has features
of its subtree (text density, link share, punctuation), its attribute tokens, its tag, its
depth and its siblings. Gradient-boosted trees, trained with Spark's ML library on at most `SAMPLE`
pages, give each node a probability of being content. The labels of those pages come from their
own semantic marks (article and main against menus, footers, adverts and the like); every training
node also occurs a second time with its marks hidden, so the trees learn to judge pages without
marks by density, depth and siblings.

Decoding chooses for every node: keep its whole subtree, drop it, or decide child by child at a
price. The choice of greatest likelihood over the tree is found bottom-up, so no kept node stands
under a dropped one and the other way round.

Defined results: null, empty and textless pages give an empty text; unclosed and unknown tags are
tolerated; a `<` that opens no tag is text; with no marked page to learn from, marks alone decide;
repeated rows are extracted each; extra columns pass through, except `text`, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 600
TREES, DEPTH = 10, 4
MIXED = 1.0  # price of deciding child by child
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
# Without a closing tag, these run to the end of the page; of the others only the tag is left out.
ENDLESS = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "html body article main section div header footer nav aside form fieldset figure figcaption blockquote pre address "
    "details summary dialog menu ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 hr center".split()
)
# What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "p": ({"p"}, {"td", "th", "table"}),
}
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner promo sponsor sponsored sidebar widget related recommended share "
    "social menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead cookie cookies consent "
    "notice notification alert popup modal overlay newsletter subscribe signup login search form comment comments reply "
    "replies discussion disqus legal copyright".split()
)
MAIN_WORDS = frozenset("article content main post story entry body text".split())
MARKS = ("aside_tag", "main_tag", "aside_word", "main_word", "under_aside", "under_main", "heading", "item")
NAMES = (
    *MARKS, "chars", "words", "link_share", "density", "points", "word_length", "depth", "children", "siblings", "place",
    "same_tag", "sibling_chars", "parent_share", "page_share",
)


@dataclass
class Page:
    """Block nodes in page order, root first, and the runs of text under each."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [-1])
    words: list[frozenset] = field(default_factory=lambda: [frozenset()])
    inline: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


def attribute_words(attributes: str) -> frozenset:
    out = set()
    for m in ATTRIBUTE.finditer(attributes):
        out.update(SPLIT.split((m[2] or m[3] or m[4] or "").lower()))
    out.discard("")
    return frozenset(out)


def parse(source: str | None) -> Page:
    page, source = Page(), source or ""
    stack: list[tuple[str, int]] = [("#", 0)]  # tag and block node
    parts: list[str] = []
    state = {"links": 0, "linked": 0}

    def flush(node: int) -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.runs.append((node, text, min(state["linked"], len(text))))
            parts.clear()
        state["linked"] = 0

    def say(raw: str) -> None:
        text = html.unescape(raw)
        parts.append(text)
        if state["links"]:
            state["linked"] += len(text)

    def pop_to(depth: int) -> None:
        """Close the open elements from this depth on."""
        node = stack[-1][1]
        if any(stack[k][1] != stack[depth - 1][1] for k in range(depth, len(stack))):
            flush(node)
        state["links"] -= sum(t == "a" for t, _ in stack[depth:])
        del stack[depth:]

    at, n = 0, len(source)
    unclosed: set[str] = set()  # no closing tag stands behind this place, nor behind a later one
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                pop_to(depth)
            continue
        if name in RAW:
            if name == "svg" and m[3].endswith("/"):
                continue
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if close:
                at = close.end()
            elif name in ENDLESS:
                at = n
            else:
                unclosed.add(name)
            continue
        if name in BLOCK and name != "p":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ("p", "td", "th", "table")), 0)
            if depth and stack[depth][0] == "p":
                pop_to(depth)
        if name in CLOSES:
            closed, ends = CLOSES[name]
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in closed or stack[k][0] in ends), 0)
            if depth and stack[depth][0] in closed:
                pop_to(depth)
        node = stack[-1][1]
        if name in BLOCK:
            flush(node)
            if name not in VOID:
                page.tag.append(name)
                page.parent.append(node)
                page.words.append(attribute_words(m[3]) if m[3] else frozenset())
                page.inline.append(0)
                stack.append((name, len(page.tag) - 1))
        elif name == "br":
            parts.append(" ")
        elif name not in VOID and not m[3].endswith("/"):
            page.inline[node] += 1
            state["links"] += name == "a"
            stack.append((name, node))
    flush(stack[-1][1])
    return page


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tag)
    chars, words, linked, points = (np.zeros(n) for _ in range(4))
    for node, text, link in page.runs:
        chars[node] += len(text)
        words[node] += text.count(" ") + 1
        linked[node] += link
        points[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
    tags = np.array(page.inline, float) + 1
    parent = page.parent
    for node in range(n - 1, 0, -1):
        up = parent[node]
        chars[up] += chars[node]
        words[up] += words[node]
        linked[up] += linked[node]
        points[up] += points[node]
        tags[up] += tags[node]
    children: list[list[int]] = [[] for _ in range(n)]
    for node in range(1, n):
        children[parent[node]].append(node)
    out = np.zeros((n, len(NAMES)))
    depth, under_aside, under_main = [0] * n, [0] * n, [0] * n
    for node in range(n):
        up, tag = parent[node], page.tag[node]
        if up >= 0:
            depth[node] = depth[up] + 1
        above_aside, above_main = (under_aside[up], under_main[up]) if up >= 0 else (0, 0)
        aside_tag = tag in ASIDE_TAGS or tag == "header" and not above_main
        aside_word, main_word = not page.words[node].isdisjoint(ASIDE_WORDS), not page.words[node].isdisjoint(MAIN_WORDS)
        under_aside[node] = int(above_aside or aside_tag or aside_word)
        under_main[node] = int(above_main or tag in MAIN_TAGS)
        beside = children[up] if up >= 0 else [node]
        family = max(1.0, chars[up] if up >= 0 else chars[node])
        out[node] = (
            aside_tag, tag in MAIN_TAGS, aside_word, main_word, under_aside[node], under_main[node],
            tag[0] == "h" and tag[1:].isdigit(), tag in ("li", "dt", "dd", "td", "th"),
            math.log1p(chars[node]), math.log1p(words[node]), linked[node] / max(1.0, chars[node]), math.log1p(chars[node] / tags[node]),
            points[node] / max(1.0, words[node]), chars[node] / max(1.0, words[node]), depth[node], len(children[node]), len(beside),
            0.0, 0.0, math.log1p(family / len(beside)), chars[node] / family, chars[node] / max(1.0, chars[0]),
        )
    for kids in children:
        same: dict[str, int] = {}
        for k in kids:
            same[page.tag[k]] = same.get(page.tag[k], 0) + 1
        for i, k in enumerate(kids):
            out[k, 17], out[k, 18] = i / len(kids), same[page.tag[k]] / len(kids)
    return out


def taught(page: Page, x: np.ndarray) -> np.ndarray | None:
    """Labels by a page's own marks: 1 if most of the node's text is marked as content. None without marks."""
    own = (x[:, 5] > 0) & (x[:, 4] == 0)
    if not x[:, 5].any():
        return None
    good, total = np.zeros(len(x)), np.zeros(len(x))
    for node, text, _ in page.runs:
        total[node] += len(text)
        good[node] += len(text) * own[node]
    for node in range(len(x) - 1, 0, -1):
        total[page.parent[node]] += total[node]
        good[page.parent[node]] += good[node]
    return np.where(total > 0, good * 2 > total, -1).astype(int)


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """For every run of text whether it is kept."""
    n = len(page.tag)
    p = np.clip(p, 1e-3, 1 - 1e-3)
    yes, no = np.log(p), np.log1p(-p)
    keep, drop = yes.copy(), no.copy()
    mixed = np.full(n, -MIXED)
    has_own = np.zeros(n, bool)
    for node, _, _ in page.runs:
        has_own[node] = True
    mixed += np.where(has_own, np.maximum(yes, no), 0.0)
    best, choice = np.zeros(n), np.zeros(n, int)
    for node in range(n - 1, -1, -1):
        options = (keep[node], drop[node], mixed[node])
        choice[node] = max((0, 1, 2), key=lambda k: options[k]) if node else 2
        best[node] = options[choice[node]]
        up = page.parent[node]
        if up >= 0:
            keep[up] += keep[node]
            drop[up] += drop[node]
            mixed[up] += best[node]
    state = [0] * n  # 0 kept whole, 1 dropped whole, 2 open
    for node in range(n):
        up = page.parent[node]
        state[node] = choice[node] if up < 0 or state[up] == 2 else state[up]
    return [state[node] == 0 or state[node] == 2 and bool(p[node] >= 0.5) and node > 0 for node, _, _ in page.runs]


@dataclass
class Trees:
    """Flat trees: per tree (feature, threshold, left, right, value) arrays, and their weights."""

    trees: list[tuple[list, list, list, list, list]]
    weights: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.where(x[:, 4] > 0, 0.05, np.where(x[:, 5] > 0, 0.95, 0.4))
        margin = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            feature, threshold, left, right, value = map(np.array, (feature, threshold, left, right, value))
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                go_left = x[np.arange(len(x)), feature[at]] <= threshold[at]
                at = np.where(go_left, left[at], right[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _flat(root) -> tuple[list, list, list, list, list]:
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(node.prediction())
        if node.subtreeDepth() > 0:
            feature[i], threshold[i] = node.split().featureIndex(), node.split().threshold()
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    add(root)
    return feature, threshold, left, right, value


def fit(pages: DataFrame, source: str = "html", sample: int = SAMPLE) -> Trees:
    """Boosted trees from the marked pages among at most `sample`, by lowest hash of the source."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = pages.select(F.col(source).alias("html")).filter(F.col("html").isNotNull())
    chosen = chosen.select("html", F.xxhash64("html").alias("order"))
    # The lowest hashes first, without the pages: the bound is on what meets in one place.
    bound = chosen.select("order").distinct().orderBy("order").limit(sample)
    chosen = chosen.join(F.broadcast(bound), "order").dropDuplicates(["order"]).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for value in batch.column(0):
                page = parse(value.as_py())
                x = features(page)
                y = taught(page, x)
                if y is None:
                    continue
                for hidden in (False, True):
                    shown = x.copy()
                    if hidden:
                        shown[:, : len(MARKS)] = 0.0
                    rows += [r for r, label in zip(shown.tolist(), y, strict=True) if label >= 0]
                    labels += [float(label) for label in y if label >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["x", "label"])

    drawn = chosen.mapInArrow(run, "x array<double>, label double")
    rows = drawn.select(array_to_vector("x").alias("features"), "label").repartition(4).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return Trees([], [])
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(rows)
    finally:
        rows.unpersist()
    return Trees([_flat(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights))


def main_text(page: Page, p: np.ndarray) -> str:
    return "\n".join(text for (_, text, _), kept in zip(page.runs, decode(page, p), strict=True) if kept)


def extracted(pages: DataFrame, model: Trees, source: str = "html") -> DataFrame:
    """`pages` with the main text in `text`; the source column is dropped."""
    kept = [f for f in pages.schema if f.name not in ("text", source)]
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            texts: list[str] = []
            for low in range(0, batch.num_rows, 64):
                group = [parse(v.as_py()) for v in batch.column(at).slice(low, 64)]
                x = [features(g) for g in group]
                p = model(np.concatenate(x))
                ends = np.cumsum([len(a) for a in x])
                texts += [main_text(g, q) for g, q in zip(group, np.split(p, ends[:-1]), strict=True)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, "text"])

    return pages.select(*(f.name for f in kept), source).mapInArrow(run, schema)
