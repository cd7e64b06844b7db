"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch. A text's set is its distinct word shingles. Round i of a sketch of t coordinates hashes
every element to a bin; the rounds from t to 2t put all elements into bin i - t. A coordinate
takes the least hash of the first round that reaches it, so every coordinate is filled, in
about t ln t hashes for any set, and the share of equal coordinates concentrates around the
Jaccard similarity as sharply as t independent minima. `BANDS` bands of `WIDTH` coordinates
make two sets of similarity 0.8 meet in a band except with probability (1 - 0.8^5)^40 < 2e-7.

Groups. Rows of equal sets form a class first (one aggregate on a 128-bit print of the set);
only one representative per class goes on, so copies are never paired. In every band the member
that meets most others is the hub. Each representative is verified on the full sets against its
best hub; components follow. Where members of a band are still in different components, all are
compared with one hub of their group, which gives the exact set of elements each has gained and
lost. Two members differ in just the edits that one of them has, so what is left is a join on
common edits: a link needs so many that it shows among the rarest ones, and edits of one member
only make no pair. Members that share a common edit become a group with a hub of its own, until
no group is apart. So a large group of near copies costs some comparisons per member, and every
pair that meets in a band is verified, connected already, or ruled out by its edits.

Intermediates are written to the shared folder; joins whose key may be hot are plain shuffle
joins, whose large partitions adaptive execution splits. Nothing is collected but row counts.

Defined results: null, empty and blank texts have an empty set, no links and a component of
their own; a text with fewer words than a shingle is one shingle; a row without doc_id has no
component and is kept; rows that repeat a doc_id are one node; an empty table gives no rows.
Other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import written
from labelproof.llm.tokens import Recent

BANDS = 40
WIDTH = 5
COORDINATES = BANDS * WIDTH
BROADCAST_IDS = 2_000_000
# An edit that so many members hold among their rarest isn't joined; they get a hub of their own.
HOT = 1024
SKETCH = "doc_id long, n_shingles long, print binary, bands array<long>"
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
SEEDS = (np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x9FB21C651E98DF25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: both byte methods know ASCII only."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The exact set of a text, as the verification compares it."""
    w = words(text)
    return {tuple(w)} if 0 < len(w) < size else set(zip(*(w[i:] for i in range(size)), strict=False))


def hashed_shingles(text: str | None, size: int, memory: Recent) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the set."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memory.__getitem__, w), np.uint64, len(w))
    if len(w) < size:
        x = np.array([len(w)], np.uint64)
        for i in range(len(w)):
            x = _mixed(x * BASE + h[i : i + 1])
        return x
    n = len(w) - size + 1
    x = h[:n].copy()
    for i in range(1, size):
        x = x * BASE + h[i : i + n]
    return np.unique(_mixed(x))


def sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a set of hashes that isn't empty."""
    out, empty = np.zeros(t, np.uint64), np.ones(t, bool)
    i = 0
    while True:
        rounds = np.arange(i, min(2 * t, i + max(1, 1500 // len(x))))
        h = _mixed(x[None, :] + SEEDS[rounds, None])
        h.sort(axis=1)
        bins = ((h >> np.uint64(33)) % np.uint64(t)).astype(np.int64)
        bins[rounds >= t] = (rounds[rounds >= t] - t)[:, None]
        bins, h = bins.ravel(), h.ravel()
        first = np.full(t, -1)
        first[bins[::-1]] = np.arange(len(bins))[::-1]
        fill = empty & (first >= 0)
        out[fill] = h[first[fill]]
        empty &= first < 0
        if not empty.any():
            return out
        i = int(rounds[-1]) + 1


def bands(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = coordinates.reshape(-1, WIDTH)
    key = np.arange(len(parts), dtype=np.uint64)
    for i in range(WIDTH):
        key = _mixed(key * BASE + parts[:, i])
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """doc_id, size of the set, its 128-bit print (null if empty) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Recent(xxhash.xxh3_64_intdigest, 200_000)
        for batch in batches:
            sizes, prints, keys = [], [], []
            for value in batch.column(1):
                x = hashed_shingles(value.as_py(), size, memory)
                sizes.append(len(x))
                prints.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                keys.append(bands(sketch(x)) if len(x) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "print", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SKETCH)


RESULT = "a long, b long, similarity double, linked boolean, edits array<long>"


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, edits: bool = False) -> DataFrame:
    """`pairs` (a, b) with what their full sets tell.

    similarity; linked: 100 * common >= percent * united; and, if asked for, hashes of the
    elements that a has gained and lost against b.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct(), "wanted")
    # Counted, so the list of ids is broadcast only while it is short; texts then stay where they are.
    few = wanted.count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text_a", "text_b"))
            similar, linked, changed, last, right = [], [], [], None, set()
            for i in range(batch.num_rows):
                left, text = shingles(ta[i].as_py(), size), tb[i].as_py()
                if text != last:
                    right, last = shingles(text, size), text
                common = len(left & right)
                united = len(left) + len(right) - common
                similar.append(common / united if united else 0.0)
                linked.append(100 * common >= percent * united > 0)
                # One element is gained or lost, never both: the hash of the element alone tells which edit it is.
                changed.append([xxhash.xxh3_64_intdigest(b" ".join(g)) - 2**63 for g in left ^ right] if edits else None)
            kinds = (pa.float64(), pa.bool_(), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip((similar, linked, changed), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b, *columns], ["a", "b", "similarity", "linked", "edits"])

    return both.mapInArrow(run, RESULT)


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the nodes with an edge (a, b).

    Every round each node takes the least label beside it and then its label's label; labels are
    written each round, and the loop ends when none has changed.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), "labels")
    while True:
        low = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        hooked = labels.join(low.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("component")
        )
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = written(
            hooked.join(jump, "component").select("node", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("changed")),
            "labels",
        )
        changed = labels.filter("changed").count()
        labels = labels.drop("changed")
        if not changed:
            return labels


def joined(connected: DataFrame, edges: DataFrame) -> DataFrame:
    """`connected` (node, component) after more edges: only what they join is walked."""
    named = edges.select("a", "b").join(connected.toDF("a", "low_a"), "a", "left").join(connected.toDF("b", "low_b"), "b", "left")
    named = named.select(F.coalesce("low_a", "a").alias("a"), F.coalesce("low_b", "b").alias("b")).filter("a != b")
    named = written(named.distinct(), "joins")
    if named.isEmpty():
        return connected
    merged = components(named)
    fresh = merged.select("node", F.col("node").alias("component")).join(connected, "node", "left_anti")
    every = connected.union(fresh).join(merged.toDF("component", "root"), "component", "left")
    return written(every.select("node", F.coalesce("root", "component").alias("component")), "labels")


def _close(a: str, b: str, percent: int):
    """The lengths allow a link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _most(a: Column, b: Column, percent: int) -> Column:
    """So many elements two linked sets of these sizes may differ in."""
    return F.floor((a + b) * (100 - percent) / (100 + percent) + 1e-9)


def _apart(groups: DataFrame, connected: DataFrame) -> DataFrame:
    """`groups` (group, rep, ...) that hold several components, with each member's component."""
    named = groups.join(connected.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    several = named.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return named.join(several.select("group"), "group")


def _candidates(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of one hub whose edits can be alike enough, and the hot edits: (group, rep).

    `members` has hub, rep, n_shingles, component and edits. Two members differ in exactly the
    edits that one of them has. A link needs so many common edits that the rarest `most` / 2 + 1
    of the member with fewer edits, and the rarest `most` + 1 of the other, hold a common one.
    """
    # The largest sets that may be linked with this one.
    largest = F.floor(F.col("n_shingles") * 100 / percent)
    members = members.withColumn("most", _most(F.col("n_shingles"), largest, percent)).withColumn("n_edits", F.size("edits"))
    each = members.select("hub", "rep", F.explode("edits").alias("edit"))
    often = each.groupBy("hub", "edit").agg(F.count("*").alias("often")).filter("often > 1")
    # An edit of one member only can't be common; it still takes its place among the rarest.
    held = each.join(often, ["hub", "edit"]).groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("often", "edit"))).alias("shared"))
    held = members.drop("edits").join(held, ["hub", "rep"])
    alone = F.col("n_edits") - F.size("shared")
    first = F.greatest(F.col("most") + 1 - alone, F.lit(0)).cast("int")
    held = held.select(
        "hub", "rep", "n_shingles", "component", "n_edits", "most", alone.alias("alone"),
        F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "edit"),
    )
    held = held.withColumn("edit", F.col("edit.edit")).withColumn("rank", F.col("alone") + F.col("at"))
    held = held.withColumn("rare", F.col("rank") <= F.floor(F.col("most") / 2)).drop("alone", "at", "most")
    held = written(held, "edits")
    counts = held.groupBy("hub", "edit").agg(F.count_if("rare").alias("rare"))
    cool, hot = counts.filter((F.col("rare") > 0) & (F.col("rare") <= HOT)), counts.filter(F.col("rare") > HOT)
    some = held.join(cool.select("hub", "edit"), ["hub", "edit"])
    other = some.select("hub", "edit", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n_shingles", "component", "n_edits", "rank")))
    order = (F.col("n_edits") < F.col("n_edits_b")) | ((F.col("n_edits") == F.col("n_edits_b")) & (F.col("rep") < F.col("rep_b")))
    # Where the rarest common edit stands, as many others must follow in both as a link needs.
    allowed = _most(F.col("n_shingles"), F.col("n_shingles_b"), percent)
    follow = F.least(F.col("n_edits") - F.col("rank"), F.col("n_edits_b") - F.col("rank_b"))
    enough = follow * 2 >= F.col("n_edits") + F.col("n_edits_b") - allowed
    apart = (F.col("component") != F.col("component_b")) & _close("n_shingles", "n_shingles_b", percent)
    pairs = some.filter("rare").join(other, ["hub", "edit"]).filter(order & apart & enough)
    pairs = written(pairs.select("hub", F.col("rep").alias("a"), F.col("rep_b").alias("b")).distinct(), "meetings")
    edits = members.select("hub", "rep", "n_shingles", "edits")
    both = pairs.join(edits.toDF("hub", "a", "n_a", "edits_a"), ["hub", "a"]).join(edits.toDF("hub", "b", "n_b", "edits_b"), ["hub", "b"])
    common = F.size(F.array_intersect("edits_a", "edits_b"))
    alike = F.size("edits_a") + F.size("edits_b") - 2 * common <= _most(F.col("n_a"), F.col("n_b"), percent)
    pairs = both.filter(alike).select("a", "b").distinct()
    groups = held.join(hot.select("hub", "edit"), ["hub", "edit"]).select(F.xxhash64("hub", "edit").alias("group"), "rep")
    return pairs, written(groups, "hot-edits")


def links(reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component of the representatives that have a link; the edges walked are verified ones."""
    keyed = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    met = written(keyed.join(shared, "band"), "met")
    # The member that meets most others in its bands, the lowest id of such; then the best that
    # any member of one's bands has found, so that a group agrees on one hub.
    weight = written(met.groupBy("rep").agg(F.sum("members").alias("weight")), "weights")
    own = F.struct("weight", (-F.col("rep")).alias("low"), F.col("n_shingles").alias("size")).alias("hub")
    held = met.join(weight, "rep").select("band", "rep", "n_shingles", own)
    for _ in range(2):
        top = held.groupBy("band").agg(F.max("hub").alias("hub"))
        best = held.select("band", "rep").join(top, "band").groupBy("rep").agg(F.max("hub").alias("hub"))
        held = met.select("band", "rep", "n_shingles").join(best, "rep")
    best = written(held.groupBy("rep").agg(F.first("hub").alias("hub"), F.first("n_shingles").alias("n_shingles")), "hubs")
    stars = best.select(F.col("rep").alias("a"), (-F.col("hub.low")).alias("b"), "n_shingles", F.col("hub.size").alias("size"))
    stars = stars.filter(F.col("a") != F.col("b")).filter(_close("n_shingles", "size", percent))
    tested = written(verified(stars, docs, size, percent), "stars")
    connected = components(tested.filter("linked"))

    # Groups of representatives that are still apart. Sets of a link have sizes of one step of the
    # scale or of two neighbouring ones, so a band falls into groups of two steps each.
    step = F.floor(F.ln("n_shingles") / max(math.log(100 / percent) * 1.001, 1e-6)).cast("long")
    bands = met.select(F.col("band").alias("group"), "rep", "n_shingles")
    steps = F.explode(F.array(step, step + 1))
    groups = _apart(bands, connected).withColumn("step", steps).select(F.xxhash64("group", "step").alias("group"), "rep")
    known = best.select("rep", "n_shingles")
    while True:
        groups = written(_apart(groups.join(known, "rep").join(weight, "rep"), connected), "apart")
        if groups.isEmpty():
            return connected
        # Every member is compared with the hub of its group; a hub has no edits and leaves the group.
        top = groups.groupBy("group").agg(F.max(F.struct("weight", (-F.col("rep")).alias("low"))).alias("hub"))
        under = groups.join(top.select("group", (-F.col("hub.low")).alias("hub")), "group").filter(F.col("rep") != F.col("hub"))
        under = written(under.select("rep", "hub", "n_shingles").distinct(), "under")
        told = written(verified(under.select(F.col("rep").alias("a"), F.col("hub").alias("b")), docs, size, percent, edits=True), "told")
        connected = joined(connected, told.filter("linked"))
        edited = told.select(F.col("a").alias("rep"), F.col("b").alias("hub"), "edits")
        members = _apart(under.withColumnRenamed("hub", "group"), connected).withColumnRenamed("group", "hub")
        members = written(members.join(edited, ["rep", "hub"]), "members")
        if members.isEmpty():
            return connected
        pairs, groups = _candidates(members, percent)
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            connected = joined(connected, written(verified(pairs, docs, size, percent), "links").filter("linked"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (lowest doc_id reachable) and kept, one row per row of docs.

    Texts are linked when 100 * common >= percent * united over their sets of `size`-word shingles.
    """
    drawn = written(sketches(docs, size), "sketches")
    known = drawn.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(known.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), ["print", "doc_id"]).select(
        F.col("doc_id").alias("rep"), "n_shingles", "bands"
    )
    # Two classes of one repeated id are one node already: the id is the node.
    connected = links(reps, docs, size, percent).withColumnRenamed("node", "rep")
    named = classes.join(connected, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    return (
        drawn.select("doc_id", "n_shingles", "print")
        .join(named, "print", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def check_sql(size: int, percent: int) -> str:
    """The same result in DuckDB's SQL by counting the common shingles of all pairs of `documents`."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT k, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' ')) END) AS g
  FROM d
), n AS (SELECT k, doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n x ON x.k = c.a JOIN n y ON y.k = c.b
  WHERE 100 * c.c >= {percent} * (x.n + y.n - c.c)
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (k) LEFT JOIN low ON low.a = d.doc_id
"""
