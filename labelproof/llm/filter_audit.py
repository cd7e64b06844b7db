"""Audit of how filters interact: what each filter of a sequence removes, in every order.

One pass over the texts gives each row five fail bits. Rows are counted by part and bits, so a
part becomes a 2x2x2x2x2 tensor of counts (axis value 1: fails that filter), once for all rows,
once for the good and once for the toxic ones. Every figure of every step of every order is a
contraction of that tensor with one vector per axis: pass (1, 0), fail (0, 1) or all (1, 1).

The duplicate filter needs the smallest id of each text. Texts are compared by their SHA-256
digest and never shuffled; a digest meets its smallest id on (digest, id), a key that no group of
copies makes heavy, and what isn't met is counted as the rest. Repeated rows are aggregated first.

Defined results: a null text is an empty one; a null part is the empty string; a row without an
id isn't a copy of anything, nor is anything a copy of it; rows that repeat an id aren't copies of
each other; an id with several label rows is good (toxic) if one of them says so; an empty table
gives no rows. Columns of the caller that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelproof.llm.common import words_of, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("rows", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_bits(text: Column) -> Column:
    """Fail bits of the four filters that read one text, A the highest of five; E's bit is 0."""
    words = words_of(text)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    whole = F.coalesce(text, F.lit(""))
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    fails = [n < 200, distinct * 100 < n * 50, capitals * 100 > F.length(whole) * 2, whole.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits + F.when(fail, F.lit(1 << (4 - i))).otherwise(F.lit(0))
    return bits


def counted(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """part, bits, rows, good, toxic: the cells that aren't empty, 32 at most in a part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(
            F.col("doc_id").alias("id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            text_bits(F.col("text")).alias("bits"),
        )
        .groupBy("id", "part", "digest", "bits")
        .agg(F.count("*").alias("rows"))
    )
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")
    )
    # Rows without an id are kept out of the joins, where they would all have one key.
    named = rows.filter(F.col("id").isNotNull()).join(marks, "id", "left")
    named = written(named.select("id", "part", "digest", "bits", "rows", "q", "t"), "audit-rows")
    first = named.groupBy("digest").agg(F.min("id").alias("id"))
    sums = [
        F.sum("rows").alias("rows"),
        F.sum(F.col("rows") * F.coalesce(F.col("q"), F.lit(0))).alias("good"),
        F.sum(F.col("rows") * F.coalesce(F.col("t"), F.lit(0))).alias("toxic"),
    ]
    every = named.groupBy("part", "bits").agg(*sums)
    firsts = named.join(first, ["digest", "id"], "left_semi").groupBy("part", "bits").agg(*sums)
    others = rows.filter(F.col("id").isNull()).groupBy("part", "bits")
    others = others.agg(F.sum("rows").alias("rows"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    # A row fails E if it isn't a first one: E's cell is everything less the firsts.
    copies = every.unionByName(firsts.select("part", "bits", *(-F.col(m) for m in MEASURES)).toDF("part", "bits", *MEASURES))
    cells = copies.withColumn("bits", F.col("bits") + 1).unionByName(firsts).unionByName(others)
    return cells.groupBy("part", "bits").agg(*(F.sum(m).alias(m) for m in MEASURES))


def _selectors() -> dict[str, np.ndarray]:
    """Figure to an array (order and step, axis, 2) of the vectors to contract with."""
    found: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in ORDERS:
        for step, letter in enumerate(order):
            before = order[:step]
            found["kept"].append([PASS if f in before or f == letter else ALL for f in FILTERS])
            found["removed"].append([FAIL if f == letter else PASS if f in before else ALL for f in FILTERS])
            found["failing"].append([FAIL if f == letter else ALL for f in FILTERS])
            found["unique_fails"].append([FAIL if f == letter else PASS for f in FILTERS])
    return {k: np.array(v, np.int64) for k, v in found.items()}


def contracted(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of shape (parts, 3 measures, 32 cells) to figures of shape (parts, 600)."""
    tensor = counts.reshape(-1, len(MEASURES), 2, 2, 2, 2, 2)

    def pick(vectors: np.ndarray) -> np.ndarray:
        return np.einsum("pmabcde,ka,kb,kc,kd,ke->pmk", tensor, *vectors.transpose(1, 0, 2), optimize=True)

    picked = {name: pick(vectors) for name, vectors in _selectors().items()}
    removed = picked["removed"]
    letters = np.array([[f == c for f in FILTERS] for order in ORDERS for c in order], np.int64)
    return {
        "kept": picked["kept"][:, 0],
        "removed": removed[:, 0],
        "redundant": picked["failing"][:, 0] - removed[:, 0],
        "unique_fails": picked["unique_fails"][:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": np.einsum("pk,kf,jf->pj", removed[:, 0], letters, letters, optimize=True),
    }


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows a part, a few parts at a time."""
    orders = [order for order in ORDERS for _ in FILTERS]
    steps = np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            some = batch.slice(k, 64)
            counts = np.zeros((some.num_rows, len(MEASURES), 32), np.int64)
            for i, cells in enumerate(some.column("cells").to_pylist()):
                for cell in cells:
                    counts[i, :, cell["bits"]] = [cell[m] for m in MEASURES]
            columns = [
                pa.array([p for p in some.column("part").to_pylist() for _ in orders], pa.string()),
                pa.array(orders * some.num_rows, pa.string()),
                pa.array(np.tile(steps, some.num_rows)),
                *(pa.array(figure.reshape(-1)) for figure in contracted(counts).values()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    cells = counted(docs, labels, part)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("bits", *MEASURES)).alias("cells"))
    return parts.mapInArrow(_figures, SCHEMA)


# The same figures by bit masks: a row is removed by the first filter of the order that it fails.
CHECK = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), f(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o(filter_order, step, bit, before) AS (
  SELECT letter, 1, bit, 0 FROM f
  UNION ALL
  SELECT o.filter_order || f.letter, o.step + 1, f.bit, o.before + o.bit
  FROM o, f WHERE o.step < 5 AND (o.before + o.bit) & f.bit = 0
), s AS (
  SELECT w.filter_order, o.step, o.bit, o.before FROM o JOIN o AS w ON w.step = 5 AND starts_with(w.filter_order, o.filter_order)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (bits & (before + bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bits & before > 0 AND bits & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bits & before = 0 AND bits & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (bits & before = 0 AND bits & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
