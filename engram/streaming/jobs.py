"""Structured Streaming forms of the interval and session jobs.

Event time must be a TIMESTAMP.  Each job has a batch twin in ``engram.operators``
that it is tested against.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream, few files a trigger; ``ts`` becomes a TIMESTAMP."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def watch_folder(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    """Files dropped into a folder, one a trigger; read files move to ``archive``."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 1)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reader.schema(schema).load(path).withColumn("sha256", F.sha2("content", 256))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of each sitting, once it has closed."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def decay_ticks(events: DataFrame, every: str = "90 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, tick, n, total): tumbling windows that drive the closed-form decay."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("tick"), "n", "total")
    )


def session_bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session, due): one row a sitting that has ended, which calls for the heavy jobs; a sitting is a burst once."""
    return session_windows(events, gap, late).select("user_id", "start", F.col("end").alias("due"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


FACT_STATE = "strength double, active boolean"


def fact_strength(events: DataFrame) -> DataFrame:
    """(subject, fact, strength, active): the keyed state of the upsert rule for repeated facts: +1 each, active at 2, a negation resets."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strength, active = state.get if state.exists else (0.0, False)
        for frame in frames:
            for negated in frame.sort_values("ts")["negated"]:
                strength, active = (0.0, False) if negated else (strength + 1, active or strength + 1 >= 2)
        state.update((strength, active))
        yield pd.DataFrame({"subject": [key[0]], "fact": [key[1]], "strength": [strength], "active": [active]})

    return events.groupBy("subject", "fact").applyInPandasWithState(
        step, "subject long, fact string, strength double, active boolean", FACT_STATE, "update", GroupStateTimeout.NoTimeout
    )


def post_turn(turns: DataFrame, stages, checkpoint: str, out: str) -> StreamingQuery:
    """Run chained, idempotent stages (functions of a batch frame) on each micro-batch of turns.

    A batch's result is the folder ``out``/batch=<id>, replaced as a whole when the batch is run
    again, so a restart neither loses nor doubles rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for stage in stages:
            batch = stage(batch)
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
