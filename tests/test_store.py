"""Store import: stamps, and self-referring tables whose parents come after their children."""

import random

import pytest
from pyspark.sql import functions as F

from engram.sources import store


def test_round_trip_with_parents_after_children(spark, tmp_path):
    rows = [(n, n + 7 if n < 50 else (999 if n == 55 else None), [float(n), 1.0]) for n in range(57)]
    table = spark.createDataFrame(rows, "id long, parent long, embedding array<double>")
    store.export_store({"t": table}, f"{tmp_path}/s", model="m1")
    back = store.import_store(spark, f"{tmp_path}/s", {"t": table.schema}, model="m1", width=2)["t"]
    inserted, links = store.in_two_passes(back, "id", "parent")
    assert inserted.where("parent is not null").count() == 0 and inserted.count() == 57
    restored = inserted.drop("parent").join(links, "id", "left")
    want = {n: (p if p != 999 else None) for n, p, _ in rows}
    assert {r["id"]: r["parent"] for r in restored.collect()} == want
    depth = {}
    for n in sorted(want, reverse=True):
        depth[n] = 0 if want[n] is None else depth[want[n]] + 1
    assert {r["id"]: r["depth"] for r in store.load_order(back, "id", "parent").collect()} == depth
    with pytest.raises(ValueError):
        store.import_store(spark, f"{tmp_path}/s", {"t": table.schema}, model="m2")
    with pytest.raises(ValueError):
        store.import_store(spark, f"{tmp_path}/s", {"t": table.schema}, width=3)
    assert store.import_store(spark, f"{tmp_path}/s", {"t": table.schema}, width=3, reembed=True)["t"].where("embedding is null").count() == 57


def test_circles_have_no_order(spark):
    r = random.Random(3)
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6), (7, None), (8, 7), (9, 100)] + [(n, r.randrange(7, n)) for n in range(10, 60)]
    got = {x["id"]: x["depth"] for x in store.load_order(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert all(got[n] is None for n in range(1, 7)) and got[7] == got[9] == 0 and got[8] == 1 and all(got[n] is not None for n in range(7, 60))
    assert store.load_order(spark.createDataFrame([], "id long, parent long"), "id", "parent").count() == 0
    assert store.load_order(spark.range(3).withColumn("parent", F.lit(None).cast("long")), "id", "parent").where("depth = 0").count() == 3
