"""Listings: pages, category index, neighbours and hierarchy units."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelproof.operators.skew import dense_positions, reliable, shared_folder


def pages(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """All rows with their page and place on it, counted from one."""
    placed = dense_positions(rows, order, "_pos")
    return (
        placed.withColumn("pagina", (F.floor(F.col("_pos") / size) + 1).cast("bigint"))
        .withColumn("lugar", (F.col("_pos") % size + 1).cast("bigint"))
        .drop("_pos")
    )


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result."""
    return rows.orderBy(*order).offset(offset).limit(size)


def page_count(total: Column, size: int) -> Column:
    """Pages of a listing; an empty one has one page."""
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")


def category_index(products: DataFrame, category: str) -> DataFrame:
    """Categories with their row count, largest first."""
    named = products.filter(F.col(category).isNotNull())
    return (
        named.groupBy(category)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(category))
    )


def neighbours(
    rows: DataFrame, group: str, order: list[str], key: str, reach: int = 3,
    chunk: int = 100_000,
) -> DataFrame:
    """Alphabetical neighbours inside a group: ``key, vecino, orden``.

    Rows get dense positions in (group, name) order. A frame over chunks of
    positions, each with ``reach`` rows of the chunks beside it, replaces one
    frame per group, so a group of any size spreads over many tasks.
    """
    columns = [group, *order, key]
    placed = dense_positions(rows.select(*columns), [F.col(c) for c in columns], "_pos")
    home = F.floor(F.col("_pos") / chunk).cast("bigint")
    place = F.col("_pos") % chunk
    seen = F.array_compact(
        F.array(
            home,
            F.when(place < reach, home - 1),
            F.when(place >= chunk - reach, home + 1),
        )
    )
    spread = placed.select(
        "*", home.alias("_home"), F.explode(F.array_distinct(seen)).alias("_chunk")
    )
    near = (
        Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(-reach, reach)
    )
    item = F.struct(F.col("_pos"), F.col(group).alias("_group"), F.col(key).alias("_key"))
    framed = spread.withColumn("_near", F.collect_list(item).over(near)).filter(
        F.col("_home") == F.col("_chunk")
    )
    same = F.filter(
        F.col("_near"),
        lambda n: (n["_group"] == F.col(group)) & (n["_pos"] != F.col("_pos")),
    )
    return framed.select(key, F.posexplode(F.slice(same, 1, 2 * reach)).alias("_i", "_n")).select(
        key, F.col("_n._key").alias("vecino"), (F.col("_i") + 1).cast("bigint").alias("orden")
    )


def drill_down(nodes: DataFrame, cap: Column) -> DataFrame:
    """Units to page through: ``id, total`` of the nodes kept under a cap.

    ``nodes`` has ``id, parent, total, leaf, raiz``; a node is entered from a
    kept-open parent. It is a unit when its total fits or it has no children
    (then its total is clipped), else its children are looked at; empty nodes
    are dropped. The walk is one recursive query that ends when no node is
    left open. A node has one parent, so only a root can be reached twice: a
    root inside a cycle is entered once, as a root.
    """
    spark = nodes.sparkSession
    # The tree may be of any depth and size.
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    alive = nodes.filter(F.col("total") > 0).withColumn("_cap", cap)
    alive = reliable(
        alive.select(
            "id", "parent", "raiz", ((F.col("total") <= F.col("_cap")) | F.col("leaf")).alias("unidad"),
            F.least("total", "_cap").cast("bigint").alias("total"),
        )
    )
    return spark.sql(
        """
        WITH RECURSIVE paso (id, unidad, total) AS (
          SELECT id, unidad, total FROM {nodos} WHERE raiz
          UNION ALL
          SELECT n.id, n.unidad, n.total FROM paso JOIN {nodos} n ON n.parent = paso.id
          WHERE NOT paso.unidad AND NOT n.raiz
        )
        SELECT id, total FROM paso WHERE unidad
        """,
        nodos=alive,
    )


class PageDirectory:
    """An ordered listing kept by ranges, so that a page reads the ranges it lies in.

    The rows are range partitioned by the order and written, one folder per range; the directory
    has one line per range with its first place and its rows.
    """

    def __init__(self, rows: DataFrame, order: list[Column], size: int, ranges: int | None = None):
        spark = rows.sparkSession
        parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.order, self.size = order, size
        self.path = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
        placed = rows.repartitionByRange(parts, *order).withColumn("_rango", F.spark_partition_id())
        placed.write.partitionBy("_rango").parquet(self.path)
        schema = placed.schema
        self.rows = spark.read.schema(schema).parquet(self.path)
        # One line per range.
        counts = sorted((r["_rango"], r["n"]) for r in self.rows.groupBy("_rango").agg(F.count("*").alias("n")).collect())
        self.lines, first = [], 0
        for number, n in counts:
            self.lines.append((number, first, n))
            first += n
        self.total = first

    def page_count(self) -> int:
        return max(1, -(-self.total // self.size))

    def page(self, number: int) -> DataFrame:
        """One page, counted from one, in order; past the last one it is empty."""
        begin = (number - 1) * self.size
        hit = [line for line in self.lines if line[1] < begin + self.size and begin < line[1] + line[2]]
        rows = self.rows.filter(F.col("_rango").isin([line[0] for line in hit]))
        skip = begin - hit[0][1] if hit else 0
        return rows.drop("_rango").orderBy(*self.order).offset(skip).limit(self.size)
