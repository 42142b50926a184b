"""The interval form of the triple upsert against the rule event by event, and the stream against both."""

import random

import pandas as pd
import pytest

from engram.operators import facts

RELATIONS = ("knows", "uses", "status", "lives_in", "works_at", "not in the vocabulary")


def hostile(n, seed, subjects=(1, 1, 1, 1, 2, 3)):
    r = random.Random(seed)
    return [
        (r.choice(subjects), r.choice(RELATIONS), r.randrange(3), r.random() < 0.25, r.choice((None, 0.1, 0.5, 0.9)), r.randrange(40) * 1_000_000)
        for _ in range(n)
    ]


SCHEMA = "subject long, relation string, target long, negated boolean, confidence double, us long"
COLUMNS = ["relation", "target", "negated", "confidence", "valid_from", "valid_until", "strength", "state"]


def plain(rows):
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    out = []
    for subject, own in frame.groupby("subject"):
        out += [(subject, *(None if pd.isna(x) else x for x in edge)) for edge in facts.upsert_subject(own)[COLUMNS].itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_intervals_equal_the_rule_event_by_event(spark, seed):
    rows = hostile(400, seed)
    rows += rows[:30]
    triples = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")  # a subject goes over many ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges, journal = facts.upsert(triples)
        got = sorted((tuple(r[c] for c in ["subject", *COLUMNS]) for r in edges.collect()), key=repr)
        actions = {r["action"]: r["count"] for r in journal.groupBy("action").count().collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)
    want = {}
    held = {}
    for serial, (subject, relation, target, negated, confidence, us) in enumerate(sorted(rows, key=lambda x: (x[5], x[1], x[2], x[3], x[4] is not None, x[4] or 0)), 1):
        for action, _ in facts.step(held.setdefault((subject, relation), {}), serial, relation, target, negated, confidence, us):
            want[action] = want.get(action, 0) + 1
    assert actions == want


def test_triples_without_parts_and_none_at_all(spark):
    rows = [(None, "knows", 1, False, 0.5, 1), (1, None, 1, False, 0.5, 1), (1, "knows", None, False, 0.5, 1), (1, "knows", 1, None, 0.5, 2), (1, "knows", 1, False, 0.5, None)]
    edges, journal = facts.upsert(spark.createDataFrame(rows, SCHEMA))
    assert [(r["target"], r["strength"], r["state"]) for r in edges.collect()] == [(1, 1.0, "pending")]
    assert [r["action"] for r in journal.collect()] == ["added"]
    assert facts.upsert(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_stream_equals_the_batch_form_in_any_order_and_over_restarts(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from pyspark.sql import functions as F

    from engram.streaming import facts as stream

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    r = random.Random(5)
    rows = [(r.choice((1, 1, 1, 2)), r.choice(RELATIONS[:5]), r.randrange(3), r.random() < 0.2, r.choice((None, 0.5, 0.9)), start + timedelta(minutes=r.randrange(50))) for _ in range(160)]
    r.shuffle(rows)
    late = [(9, "knows", 1, False, None, start + timedelta(days=n)) for n in (2, 3, 4)]  # move the watermark on
    schema = "subject long, relation string, target long, negated boolean, confidence double, ts timestamp"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate([rows[:60], rows[60:], late[:1], late[1:2], late[2:]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            # the query is stopped and started again after each part
            read = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            query = stream.upsert_stream(read, "2 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        got = stream.latest(spark.read.parquet(f"{tmp_path}/out")).where("subject <> 9")
        want = facts.upsert(spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts")))[0].select(got.columns)
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(got) == key(want)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_no_window_reads_the_rest_of_its_partition_for_every_row(spark):
    """A frame that ends with its partition is read again for every row, which is quadratic; looking ahead goes by the opposite order."""
    from pyspark.sql import functions as F

    from engram.operators import facts

    rows = [(key, at, at >> 3, at if at % 5 == 2 else None) for key in range(3) for at in range(24)]
    log = spark.createDataFrame(rows, "key int, at long, block long, x long")
    found = facts.nearest(log, ["key"], F.col("x"), "next", ahead=True)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = {(r["key"], r["at"]): r["next"] for r in found.collect()}
    assert got == {(key, at): next((x for x in range(at + 1, 24) if x % 5 == 2), None) for key, at, _, _ in rows}
