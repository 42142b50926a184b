"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from engram.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(3, "ts").write.mode("overwrite").parquet(path)
    return path


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, folder):
    return jobs.event_stream(spark, folder, spark.read.parquet(folder).schema, 10)


def test_session_windows(spark, folder, tmp_path):
    got = {(r.user_id, r.start, r.n) for r in drain(jobs.session_windows(stream(spark, folder)), "sessions", tmp_path).collect()}
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.start, r.n) for r in jobs.session_windows(batch).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)  # the last sittings are still open


def test_session_bursts_come_once(spark, folder, tmp_path):
    got = [(r.user_id, r.due) for r in drain(jobs.session_bursts(stream(spark, folder)), "bursts", tmp_path).collect()]
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.due) for r in jobs.session_bursts(batch).collect()}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want)


def test_decay_ticks(spark, folder, tmp_path):
    got = {(r.user_id, r.tick): r.n for r in drain(jobs.decay_ticks(stream(spark, folder)), "ticks", tmp_path).collect()}
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r.user_id, r.tick): r.n for r in jobs.decay_ticks(batch).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_deduplicated(spark, folder, tmp_path):
    twice = stream(spark, folder)
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert drain(jobs.deduplicated(twice, ["event_id"]), "dedup", tmp_path).count() == spark.read.parquet(folder).count()


def test_fact_strength(spark, folder, tmp_path):
    events = stream(spark, folder).select(F.col("user_id").alias("subject"), F.col("event_type").alias("fact"), F.lit(False).alias("negated"), "ts")
    out = drain(jobs.fact_strength(events), "facts", tmp_path, "update")
    got = {(r.subject, r.fact): r.s for r in out.groupBy("subject", "fact").agg(F.max("strength").alias("s")).collect()}
    want = {(r.user_id, r.event_type): float(r["count"]) for r in spark.read.parquet(folder).groupBy("user_id", "event_type").count().collect()}
    assert got == want


def test_post_turn_and_watch(spark, folder, tmp_path):
    seen = []
    jobs.post_turn(stream(spark, folder), [lambda b: b.where("value > 1"), lambda b: seen.append(b.count()) or b], str(tmp_path / "post"), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(seen)
    assert sum(seen) == spark.read.parquet(folder).where("value > 1").count()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert drain(jobs.watch_folder(spark, str(tmp_path / "in")), "watch", tmp_path).count() == 1
