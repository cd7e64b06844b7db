"""Kept duplicate groups: a refresh judges the groups that changed, and no others.

Three kept tables: ``miembros`` holds the automatic verdict of every product under its group,
``lugar`` the group of each code, so that a renamed or removed product is found in the group it
leaves, and ``juzgados`` the verdicts after reconciliation. Rows of one group share a bucket, so
a refresh reads and writes the buckets of the groups it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelproof.operators.reconcile import duplicate_key, reconcile_duplicates
from labelproof.operators.skew import reliable
from labelproof.sinks.keyed import KeyedTable

SCHEMA = "ean string, nombre string, marca string, estado string, fuente_decision string, motivo string, confianza double"


class DuplicateGroups:
    """The kept state in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        def kept(name: str, key: list[str], schema: str, by: list[str] | None = None) -> KeyedTable:
            return KeyedTable(spark, f"{folder.rstrip('/')}/{name}", key, schema, buckets, by)

        self.members = kept("miembros", ["grupo", "ean"], f"grupo string, {SCHEMA}", ["grupo"])
        self.place = kept("lugar", ["ean"], "ean string, grupo string")
        self.judged = kept("juzgados", ["ean"], SCHEMA)
        self.columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None) -> int:
        """Take changed or new products, and the codes of removed ones; how many groups were judged again.

        Each table is replaced by one step of its own. The groups to judge are named by what the
        refresh brings and by the tables it starts from, so a refresh that was cut off can be
        run again with the same rows.
        """
        # A product without a name has no group; its own code keeps such products apart.
        alone = F.concat(F.lit("\u0002"), "ean")
        changed = changed.select(F.coalesce(duplicate_key(F.col("marca"), F.col("nombre")), alone).alias("grupo"), *self.columns)
        changed = reliable(changed)
        codes = changed.select("ean")
        gone = codes.limit(0) if removed is None else reliable(removed.select("ean").distinct())
        before = reliable(self.place.among(codes.union(gone)))
        touched = reliable(before.select("grupo").union(changed.select("grupo")).distinct())
        moved = before.join(changed.select("ean", "grupo"), ["ean", "grupo"], "left_anti")
        # What leaves a group goes first, then what comes; where a code stands is written last.
        self.members.delete(moved)
        self.members.put(changed)
        rows = self.members.among(touched)
        self.judged.put(reconcile_duplicates(rows.select(*self.columns)).select(*self.columns))
        if removed is not None:
            self.judged.delete(gone)
            self.place.delete(gone)
        self.place.put(changed.select("ean", "grupo"))
        return touched.count()

    def read(self) -> DataFrame:
        """All products with their reconciled verdicts."""
        return self.judged.read()
