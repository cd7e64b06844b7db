"""A kept table of keyed rows, of which a write replaces the touched buckets only.

A key belongs to one of a fixed number of buckets by its hash. A write reads the touched
buckets, makes their new rows, writes them into a folder of its own, and then moves the list
that names the folder of every bucket to the number of the next version. That list is the only
thing a reader starts from, so a reader sees a whole version or the one before, and a write that
fails leaves nothing that is ever read. Of two writers of one version the later one is refused,
on file systems where a file moves in one step.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.operators.skew import reliable
from labelproof.sinks.tables import latest, merge_counts, merge_newer, upsert


class KeyedTable:
    """Rows with unique keys in a folder that driver and executors share.

    ``buckets`` is fixed when the table is made; choose it so that a bucket fits a few tasks. Rows
    fall into buckets by ``by``, the whole key unless a part of it is named.
    """

    def __init__(
        self, spark: SparkSession, folder: str, key: list[str], schema: T.StructType | str, buckets: int = 64,
        by: list[str] | None = None,
    ):
        self.spark, self.folder, self.key, self.schema, self.buckets = spark, folder.rstrip("/"), list(key), schema, buckets
        self.by = list(by or key)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose ``by`` columns stand in ``keys``; reads only the buckets that may hold them."""
        keys = reliable(keys.select(*self.by).distinct())
        return self._current(self._touched(keys), self.version()).join(keys, self.by, "left_semi")

    def _filesystem(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _versions(self) -> list[int]:
        top, fs = self._path("lists"), self._filesystem()
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """Number of the last finished write; -1 for a table without one."""
        return max(self._versions(), default=-1)

    def buckets_of(self, version: int | None = None) -> dict[int, str]:
        """The write that holds each bucket; a bucket without rows has none. One line per bucket."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, held string").json(f"{self.folder}/lists/{version}.json")
        return {r["bucket"]: r["held"] for r in rows.collect()}

    def _files(self, held: dict[int, str]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder}/data/{write}/bucket={b}" for b, write in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, the last one by default."""
        return self._files(self.buckets_of(version))

    def _replace(self, rows: DataFrame, touched: list[int], last: int) -> None:
        """The version after ``last``: ``rows`` are all rows of the touched buckets."""
        held, write, fs = self.buckets_of(last), uuid.uuid4().hex, self._filesystem()
        fields = self.spark.createDataFrame([], self.schema).columns
        bucketed = rows.select(*fields, self._bucket().alias("bucket")).repartition("bucket")
        bucketed.write.partitionBy("bucket").parquet(f"{self.folder}/data/{write}")
        for bucket in touched:
            held.pop(bucket, None)
            if fs.exists(self._path(f"data/{write}/bucket={bucket}")):
                held[bucket] = write
        lines = self.spark.createDataFrame(sorted(held.items()), "bucket int, held string").coalesce(1)
        lines.write.json(f"{self.folder}/staged/{write}")
        (made,) = [f.getPath() for f in fs.listStatus(self._path(f"staged/{write}")) if f.getPath().getName().startswith("part-")]
        fs.mkdirs(self._path("lists"))
        name = self._path(f"lists/{last + 1}.json")
        if fs.exists(name) or not fs.rename(made, name):
            raise ValueError(f"version {last + 1} of {self.folder} exists already: another write came first")

    def _touched(self, incoming: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in incoming.select(self._bucket().alias("bucket")).distinct().collect())

    def _current(self, touched: list[int], last: int) -> DataFrame:
        held = self.buckets_of(last)
        return self._files({b: held[b] for b in touched if b in held})

    def upsert(self, incoming: DataFrame, order: list[str]) -> None:
        """The last write per key wins, in the given order of columns."""
        incoming, last = reliable(incoming), self.version()
        touched = self._touched(incoming)
        if touched:
            self._replace(upsert(self._current(touched, last), incoming, self.key, order), touched, last)

    def put(self, incoming: DataFrame) -> None:
        """Incoming rows take the place of those with their keys; of equal keys the greatest row counts."""
        others = [c for c in incoming.columns if c not in self.key]
        incoming, last = reliable(latest(incoming, self.key, others)), self.version()
        touched = self._touched(incoming)
        if touched:
            rest = self._current(touched, last).join(incoming.select(*self.key), self.key, "left_anti")
            self._replace(rest.unionByName(incoming), touched, last)

    def merge(self, incoming: DataFrame, stamp: str) -> DataFrame:
        """Incoming rows win only when their time is later; returns the counts of what happened."""
        (key,) = self.key
        incoming, last = reliable(incoming), self.version()
        touched = self._touched(incoming)
        merged = reliable(merge_newer(self._current(touched, last), incoming, key, stamp))
        if touched:
            self._replace(merged, touched, last)
        return merge_counts(merged, incoming)

    def delete(self, keys: DataFrame) -> None:
        """Remove rows by key."""
        keys, last = reliable(keys.select(*self.key).distinct()), self.version()
        touched = self._touched(keys)
        if touched:
            self._replace(self._current(touched, last).join(keys, self.key, "left_anti"), touched, last)

    def vacuum(self, keep: int = 1) -> None:
        """Drop the lists before the last ``keep`` and the files that only they name."""
        versions, fs = self._versions(), self._filesystem()
        needed = {item for v in versions[-keep:] for item in self.buckets_of(v).items()}
        for version in versions[:-keep]:
            for bucket, write in set(self.buckets_of(version).items()) - needed:
                fs.delete(self._path(f"data/{write}/bucket={bucket}"), True)
            fs.delete(self._path(f"lists/{version}.json"), False)
