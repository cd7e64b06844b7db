"""The kept table: what a write touches, what a reader sees, what a failed write leaves."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from labelproof.operators.skew import shared_folder
from labelproof.sinks.keyed import KeyedTable

SCHEMA = "ean string, cadena string, precio double, actualizado string"


def made(spark, key=("ean", "cadena"), buckets=16):
    return KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", list(key), SCHEMA, buckets)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(table):
    top = table.folder.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{top}/data") for f in names if f.startswith("part-")}


def shown(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_upserts_and_reads_back(spark):
    table = made(spark)
    first = [(f"{i:03d}", "x", 1.0, "2026-01-01") for i in range(200)]
    table.upsert(rows_of(spark, first + [("000", "x", 9.0, "2026-01-02"), ("000", "x", 8.0, "2026-01-02")]), ["actualizado", "precio"])
    want = {(r[0], r[1]): r for r in first} | {("000", "x"): ("000", "x", 9.0, "2026-01-02")}
    assert shown(table.read()) == sorted(want.values())
    second = [("003", "x", 5.0, "2026-02-01"), ("new", "y", None, "2026-02-01")]
    table.upsert(rows_of(spark, second), ["actualizado", "precio"])
    want |= {(r[0], r[1]): r for r in second}
    assert sorted(map(str, table.read().collect())) == sorted(map(str, rows_of(spark, list(want.values())).collect()))
    assert shown(table.read(0)) == sorted([("000", "x", 9.0, "2026-01-02"), *first[1:]])


def test_untouched_buckets_keep_their_files(spark):
    table = made(spark)
    table.upsert(rows_of(spark, [(f"{i:03d}", "x", 1.0, "a") for i in range(400)]), ["actualizado"])
    before, held = files(table), table.buckets_of()
    table.upsert(rows_of(spark, [("007", "x", 2.0, "b")]), ["actualizado"])
    after = files(table)
    assert all(after[f] == t for f, t in before.items()), "an old file was changed"
    moved = [b for b, v in table.buckets_of().items() if held[b] != v]
    assert len(moved) == 1 and {f.split("bucket=")[1].split("/")[0] for f in after if f not in before} == {str(moved[0])}
    table.vacuum()
    left = files(table)
    assert sum(f not in left for f in before) >= 1 and table.read().count() == 400
    assert all(f"bucket={moved[0]}/" in f for f in before if f not in left)


def test_a_failed_write_is_not_seen_and_can_be_repeated(spark):
    table = made(spark)
    table.upsert(rows_of(spark, [("a", "x", 1.0, "a"), ("b", "x", 1.0, "a")]), ["actualizado"])
    before = shown(table.read())
    bad = rows_of(spark, [("a", "x", 2.0, "b")]).withColumn("precio", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        table._replace(bad, [0], 0)
    assert table.version() == 0 and shown(table.read()) == before
    table.upsert(rows_of(spark, [("a", "x", 3.0, "c")]), ["actualizado"])
    assert shown(table.read()) == [("a", "x", 3.0, "c"), ("b", "x", 1.0, "a")]


def test_a_second_writer_of_one_version_fails(spark):
    table = made(spark)
    table.upsert(rows_of(spark, [("a", "x", 1.0, "a")]), ["actualizado"])
    before = shown(table.read())
    with pytest.raises(ValueError, match="another write came first"):
        table._replace(rows_of(spark, [("z", "x", 1.0, "a")]), list(range(16)), -1)
    assert shown(table.read()) == before and table.version() == 0


def test_merge_deletes_and_nothing(spark):
    table = made(spark, ["ean"])
    assert table.read().count() == 0 and table.version() == -1
    table.upsert(rows_of(spark, []), ["actualizado"])
    assert table.version() == -1
    counts = table.merge(rows_of(spark, [("a", "x", 1.0, "5"), ("b", "x", 1.0, "5")]), "actualizado").first()
    assert tuple(counts) == (2, 2, 0)
    counts = table.merge(rows_of(spark, [("a", "y", 2.0, "4"), ("b", "y", 2.0, "6"), ("c", "y", 2.0, "1")]), "actualizado").first()
    assert tuple(counts) == (3, 1, 1)
    assert shown(table.read()) == [("a", "x", 1.0, "5"), ("b", "y", 2.0, "6"), ("c", "y", 2.0, "1")]
    table.delete(rows_of(spark, [("a", "y", 2.0, "4"), ("nobody", "y", 2.0, "4")]))
    assert [r[0] for r in shown(table.read())] == ["b", "c"]
    again = table.merge(table.read(), "actualizado").first()
    assert tuple(again) == (2, 0, 0)
