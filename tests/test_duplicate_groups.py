"""Kept duplicate groups against the whole reconciliation."""

import random
import uuid

from labelproof.operators.duplicate_groups import SCHEMA, DuplicateGroups
from labelproof.operators.reconcile import reconcile_duplicates
from labelproof.operators.skew import shared_folder


def product(rng, i):
    state = rng.choice(["apto", "vegetariano", "no_apto", "revisar"])
    source = rng.choice(["ingredientes", "heuristica", "sin_datos"])
    return (f"{i:04d}", rng.choice(["Oreo", "OREO ", "Pan", "", None]), rng.choice(["A", "a", "", None]), state, source, "m", 0.5)


def test_deltas_equal_a_rebuild_and_touch_their_groups_only(spark):
    rng = random.Random(2)
    rows = {f"{i:04d}": product(rng, i) for i in range(60)}
    kept = DuplicateGroups(spark, f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}", buckets=8)

    def whole():
        frame = spark.createDataFrame(list(rows.values()), SCHEMA)
        return sorted(map(str, reconcile_duplicates(frame).select(*kept.columns).collect()))

    kept.refresh(spark.createDataFrame(list(rows.values()), SCHEMA))
    assert sorted(map(str, kept.read().collect())) == whole()
    # The worst member of a group goes, one is renamed, one is new, one gets better.
    removed = [e for e, r in rows.items() if r[1] == "Oreo" and r[3] == "no_apto"][:2]
    changed = [product(rng, 1), product(rng, 61), ("0003", "Nombre nuevo", "Z", "apto", "ingredientes", "m", 0.5), ("0007", "nombre nuevo", "z", "no_apto", "ingredientes", "m", 0.5)]
    for e in removed:
        del rows[e]
    changed = [c for c in changed if c[0] not in removed]
    rows |= {c[0]: c for c in changed}
    kept.refresh(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(e,) for e in removed], "ean string"))
    assert sorted(map(str, kept.read().collect())) == whole()
    # One product of a group of its own: one group is judged, the other buckets keep their files.
    held = kept.members.buckets_of()
    rows["0099"] = ("0099", "Unico", "U", "apto", "ingredientes", "m", 0.5)
    assert kept.refresh(spark.createDataFrame([rows["0099"]], SCHEMA)) == 1
    assert sum(held.get(b) != w for b, w in kept.members.buckets_of().items()) == 1
    assert sorted(map(str, kept.read().collect())) == whole()
    # The same refresh again changes nothing.
    kept.refresh(spark.createDataFrame([rows["0099"]], SCHEMA))
    assert sorted(map(str, kept.read().collect())) == whole()
