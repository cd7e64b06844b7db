"""A spread of registered queries against their check SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from labelproof.bindings.views import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "norm_registry", "ean_normalize", "src_explode_items", "merge_newer_wins", "export_summary",
    "failure_streak_cut", "hierarchy_drilldown", "harvest_queue", "tag_classify",
    "reconcile_duplicates", "search_rescue", "ml_tfidf", "build_products", "upsert_last_wins",
    "brand_map", "registry_match", "search_fulltext", "search_filters", "search_like",
    "zero_result_terms", "sink_snapshot", "sink_review_csv", "ml_split", "coverage_band",
    "corrections_load", "evidence_combine", "search_names", "search_after_delta",
    "vocabulary_after_delta", "upsert_kept_table", "merge_kept_table", "ingredients_by_dictionary",
    "page_of_listing", "reconcile_incremental", "search_ranked", "search_facets",
]


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_check(spark, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(str([_plain(r[c]) for c in columns]) for r in frame.collect())
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert got == sorted(str([_plain(r[c]) for c in columns]) for r in rows)


def test_every_inventory_query_is_registered():
    queries, checks = entry_points.queries(), entry_points.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) >= 110
