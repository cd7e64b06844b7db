"""Readers and writers on real files, and the cases a view can't show."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from labelproof.operators import listing, quality
from labelproof.rules.labels import REVIEW_COLUMNS
from labelproof.sinks import tables
from labelproof.sources import readers


def test_price_file_with_other_column_names(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id_producto,productos_descripcion,productos_marca,productos_precio_lista\n7790001000019,Galletitas,Marca,12.5\n,x,y,1\n")
    raw = readers.read_price_csv(spark, str(tmp_path / "p.csv"))
    found = readers.resolve_columns(raw.columns)
    if {"ean", "nombre"} <= set(found):
        rows = readers.normalize_prices(raw).collect()
        assert [r["nombre"] for r in rows] == ["Galletitas"]
    else:
        with pytest.raises(ValueError):
            readers.normalize_prices(raw)


def test_gzip_dump_with_quotes(spark, tmp_path):
    header = "code\tproduct_name\tbrands\tingredients_text\timage_small_url\tcountries_tags\tingredients_tags\tingredients_analysis_tags\tlabels_tags\tcategories_tags"
    lines = [header, '1\t"Pan ""rico"""\tM\tharina\t\ten:argentina,en:chile\ten:flour, en:salt\t\t\t', "2\tsin pais\tM\t\t\ten:france\t\t\t\t", "3\t\tM\t\t\ten:argentina\t\t\t\t"]
    with gzip.open(tmp_path / "d.csv.gz", "wt") as out:
        out.write("\n".join(lines) + "\n")
    rows = readers.dump_products(readers.read_dump(spark, str(tmp_path / "d.csv.gz")), "argentina").collect()
    assert [(r["code"], r["product_name"], r["ingredients_tags"]) for r in rows] == [("1", 'Pan "rico"', ["en:flour", "en:salt"])]


def test_sheets_round_trip(spark, tmp_path):
    rows = [{"ean": "2", "cadena": "vea", "ingredientes": "agua"}, {"ean": "1", "cadena": "disco", "sellos": "vegan"}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n\n")
    sheets = readers.read_sheets(spark, str(tmp_path / "in.jsonl"))
    assert sheets.count() == 2
    tables.write_json_lines(tables.snapshot(sheets), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x)["ean"] for x in text.splitlines()] == ["1", "2"] and "null" not in text
    again = readers.read_sheets(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, sheets.collect()))


def test_corrections_are_read_by_the_names_of_each_file(spark, tmp_path):
    header = ",".join(REVIEW_COLUMNS)
    line = dict.fromkeys(REVIEW_COLUMNS, "") | {"ean": "1", "estado_corregido": "apto", "revisor": "ana"}
    (tmp_path / "a.csv").write_text("﻿" + header + "\n" + ",".join(line.values()) + "\n")
    (tmp_path / "b.csv").write_text('estado_corregido,revisor,ean\nno_apto,luz,2\nvegetariano,"luz, y ana",3\nno_apto,luz,1\n')
    raw = readers.read_corrections(spark, str(tmp_path))
    assert sorted((r["ean"], r["linea"]) for r in raw.collect()) == [("1", 1), ("1", 3), ("2", 1), ("3", 2)]
    got = {r["ean"]: (r["estado"], r["revisor"]) for r in readers.load_corrections(raw).collect()}
    assert got == {"1": ("no_apto", "luz"), "2": ("no_apto", "luz"), "3": ("vegetariano", "luz, y ana")}
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_corrections(spark, str(tmp_path))


def test_no_corrections(spark, tmp_path):
    assert readers.load_corrections(readers.read_corrections(spark, str(tmp_path))).count() == 0


def test_review_file_round_trip(spark, tmp_path):
    rows = [("1", 'Nombre "raro", largo', "M", "C", "revisar", "motivo", "x" * 400)]
    queue = spark.createDataFrame(rows, "ean string, nombre string, marca string, categoria string, estado string, motivo string, ingredients_text string")
    tables.write_review_csv(tables.review_rows(queue), str(tmp_path / "out"))
    back = readers.read_corrections(spark, str(tmp_path / "out")).first()
    assert (back["ean"], back["nombre"], len(back["ingredientes"])) == ("1", 'Nombre "raro", largo', 300)


def test_streak_with_gaps_between_positions(spark):
    log = spark.createDataFrame([("r", 7 * i, i >= 2) for i in range(40)] + [("s", 3 * i, i % 3 > 0) for i in range(40)], "run string, pos long, bad boolean")
    # A streak may be longer than a chunk.
    for chunk in (25, 31, 1000, 24, 7, 1):
        kept = quality.cut_failure_streak(log, "run", "pos", F.col("bad"), streak=25, chunk=chunk)
        assert {r["run"]: r["count"] for r in kept.groupBy("run").count().collect()} == {"r": 27, "s": 40}


def test_tree_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, 100 - i, i == 9, i == 0) for i in range(10)] + [(20, 4, 3, False, False), (21, None, 2, True, False)]
    nodes = spark.createDataFrame(rows, "id long, parent long, total long, leaf boolean, raiz boolean")
    assert sorted(map(tuple, listing.drill_down(nodes, F.lit(50)).collect())) == [(9, 50), (20, 3)]


def _exported(spark, chains, image="https://images.openfoodfacts.org/images/products/" + "9" * 3000):
    return spark.createDataFrame(
        [("1", "s", "n", "apto", "off_label", "m", "c", None, None, None, image, chains)],
        "ean string, slug string, nombre string, estado string, fuente string, marca string, categoria string, confianza double, motivo string, ingredientes string, imagen string, cadenas array<string>",
    )


def test_index_keeps_long_images_and_counts_chains(spark):
    exported = _exported(spark, [f"c{i:02d}" for i in range(63)])
    rows, dicts = tables.index_rows(exported)
    back = tables.decode_index(rows, dicts).first()
    assert len(back["cadenas"]) == 63 and back["imagen"] == exported.first()["imagen"]
    rows, _ = tables.index_rows(_exported(spark, [f"c{i:02d}" for i in range(64)]))
    with pytest.raises(Exception, match="more than 63 chains"):
        rows.collect()
