"""The whole refresh, from tables to reports."""

from labelproof.bindings.views import view
from labelproof.plans import build
from labelproof.queries import verdict_queries as V
from labelproof.rules.labels import REVISAR, SRC_MODEL

FOLDER = "/root/testdata/sf0.01"


def test_refresh_reports_on_everything(spark):
    fixes = view(spark, FOLDER, "v_fix").drop("doc_id")
    done = build.refresh(*V.build_inputs(spark, FOLDER), view(spark, FOLDER, "v_registered"), fixes)
    products = done.products.collect()
    assert len({r["ean"] for r in products}) == len(products) == done.exported.count()
    settled = [r for r in products if r["fuente_decision"] == SRC_MODEL]
    assert all(r["estado"] != REVISAR and 0.65 <= r["confianza"] <= 1 for r in settled)
    metrics = {r["clase"]: r for r in done.metrics.collect()}
    assert 0 <= metrics["accuracy"]["f1"] <= 1 and metrics["macro avg"]["soporte"] == metrics["accuracy"]["soporte"] > 0
    assert done.coverage.count() == 1
    summary = {(r["seccion"], r["nombre"]): r["n"] for r in done.summary.collect()}
    assert summary["total", "total"] == len(products)
    assert sum(n for (kind, _), n in summary.items() if kind == "estado") == len(products)
