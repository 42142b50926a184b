"""Cohort retention matrix over clicks that arrive late, as known at two times.

Secondary sort: clicks are dealt by (client, time) and sorted so; a task then reads its
clients one after another, each from its first click to its last, and a change of
client or period closes a run and emits one user.  Counting distinct users therefore needs no
hash set: a task holds one batch and the open run, whatever a client's clicks.

Dealing is by ranges of (client, time, ...), not by client alone, so a client with a third of all
clicks is spread over as many tasks as its clicks need.  What a task must know of a client
that began in an earlier one is its start in each state: one row a task tells the last client
it saw and that client's starts so far, so what goes to the driver is bounded by the number of
partitions and never grows with clicks or clients.  A run that goes over the end of a task is
emitted by both; runs (not clicks) of a client meet once more, where they are merged, the two
states are compared and the segment is joined.

Defined results
---------------
* Fully equal click rows count once.  Clicks without a time or a client are dropped.
* ``late_days`` more days pass before a click arrives; a click without ``arrived_at`` is known in
  the last state only.  A null click id counts as the empty text (its crc32 is 0).
* A client's start is its earliest known purchase; clicks of the same microsecond belong to it.
  Clients without one have no rows.
* A null, NaN or infinite value is worth 0.  Clicks of before 1970 have negative cohorts.
* A client with several rows of ``clients`` has the smallest of its segments; one with none has ''.
* Extra columns of ``clicks`` are part of a row's equality; those of ``clients`` are ignored.
  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import cut, give_back, parallelism, table
from engram.sources.driver import micros

DAY_US = 86_400_000_000
PERIOD_DAYS = 3
#: State 0 knows what arrives before this time; state 1 knows all.
KNOWN_BEFORE = "2024-03-01 00:00:00"
#: No start yet.
NEVER = np.iinfo(np.int64).max


def _known_clicks(clicks: DataFrame, known_before: str, late_days: int) -> DataFrame:
    """(client, us, rank, early, cents, salt) of the distinct clicks; ``early``: state 0 knows it.

    Within one microsecond the rank puts purchases first, those that state 0 knows before others,
    so that a forward scan has met a client's start before anything that counts from it.
    """
    h = F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")), F.lit(0).cast("long"))
    arrived = micros("arrived_at") + F.when(h % 3 == 0, h % late_days).otherwise(F.lit(0).cast("long")) * DAY_US
    limit = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'{known_before}')")
    early, bought = F.coalesce(arrived < limit, F.lit(False)), F.coalesce(F.col("kind") == "purchase", F.lit(False))
    cents = F.floor(F.col("value") * 100 + 0.5)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return (
        clicks.where("ts is not null and client_id is not null")
        .distinct()
        .select(
            F.col("client_id").cast("long").alias("client"), micros("ts").alias("us"),
            F.when(bought & early, 0).when(bought, 1).otherwise(2).cast("byte").alias("rank"), early.alias("early"),
            F.when(finite, cents).otherwise(F.lit(0)).cast("long").alias("cents"), F.xxhash64("click_id").alias("salt"),
        )
    )


def _starts(client: np.ndarray, us: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each client, its earliest purchase of at most this rank) in sorted rows."""
    first = np.flatnonzero(np.r_[True, client[1:] != client[:-1]])
    return first, np.minimum.reduceat(np.where(rank <= most, us, NEVER), first)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _last_clients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: its number, the last client in it and that client's starts in its rows."""
    part, last, starts = -1, None, [NEVER, NEVER]
    for batch in batches:
        if batch.num_rows:
            client, us, rank = _columns(batch, "client", "us", "rank")
            part = batch.column(0)[0].as_py()
            if client[-1] != last:
                last, starts = int(client[-1]), [NEVER, NEVER]
            for state in (0, 1):
                starts[state] = min(starts[state], int(_starts(client, us, rank, state)[1][-1]))
    if last is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "client": [last], "start0": [starts[0]], "start1": [starts[1]]})


class Scan:
    """The stream of one state: sorted clicks go in batch by batch, closed runs (client, cohort, period, cents) come out."""

    def __init__(self, state: int, client: int | None, start: int, period_us: int, period_days: int):
        self.state, self.client, self.start = state, client, start
        self.period_us, self.period_days = period_us, period_days
        self.open = np.zeros((4, 0), np.int64)

    def take(self, client: np.ndarray, us: np.ndarray, rank: np.ndarray, early: np.ndarray, cents: np.ndarray) -> np.ndarray:
        first, starts = _starts(client, us, rank, self.state)
        if client[0] == self.client:
            starts[0] = min(starts[0], self.start)
        self.client, self.start = int(client[-1]), int(starts[-1])
        start = np.repeat(starts, np.diff(first, append=len(client)))
        counts = us >= start if self.state else (us >= start) & early
        client, us, start, cents = client[counts], us[counts], start[counts], cents[counts]
        rows = np.stack((client, start // DAY_US // self.period_days, (us - start) // self.period_us, cents))
        rows = np.concatenate((self.open, rows), axis=1)
        if not rows.shape[1]:
            return rows
        change = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
        runs = np.concatenate((rows[:3, change], np.add.reduceat(rows[3], change)[None]))
        self.open = runs[:, -1:]
        return runs[:, :-1]


RUNS_SCHEMA = "state int, client long, cohort long, period long, cents long"


def retention(
    clicks: DataFrame, clients: DataFrame, segment_col: str = "city", period_days: int = PERIOD_DAYS, known_before: str = KNOWN_BEFORE, late_days: int = 100,
) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents) of every nonempty cell."""
    spark = clicks.sparkSession
    keys = ["client", "us", "rank", "salt"]
    dealt = _known_clicks(clicks, known_before, late_days).repartitionByRange(parallelism(spark), *keys).sortWithinPartitions(*keys)
    # the ranges are drawn from a sample, so both scans below must read one dealing
    dealt = cut(dealt.select(F.spark_partition_id().alias("part"), "client", "us", "rank", "early", "cents"))

    #: A client that an earlier task ended with, and its starts until then.
    carried: dict[int, tuple[int, int, int]] = {}
    client, starts = None, (NEVER, NEVER)
    ends = dealt.select("part", "client", "us", "rank").mapInArrow(_last_clients, "part int, client long, start0 long, start1 long")
    for end in sorted(ends.collect()):
        own = (end["start0"], end["start1"])
        carried[end["part"]] = (client, *starts)
        starts = tuple(map(min, starts, own)) if end["client"] == client else own
        client = end["client"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: list[Scan] = []
        made = lambda state, runs: pa.RecordBatch.from_arrays([pa.array(np.full(runs.shape[1], state, "i4")), *map(pa.array, runs)], names=["state", "client", "cohort", "period", "cents"])
        for batch in batches:
            if not batch.num_rows:
                continue
            if not scans:
                before, *start = carried[batch.column(0)[0].as_py()]
                scans = [Scan(state, before, start[state], period_days * DAY_US, period_days) for state in (0, 1)]
            columns = _columns(batch, "client", "us", "rank", "early", "cents")
            for one in scans:
                yield made(one.state, one.take(*columns))
        for one in scans:
            yield made(one.state, one.open)
        give_back()

    runs = dealt.mapInArrow(scan, RUNS_SCHEMA).repartition(parallelism(spark), "client")
    # all below is dealt by client already; a client has no more rows than periods, and one more for each task it goes over
    users = runs.groupBy("client", "state", "cohort", "period").agg(F.sum("cents").alias("cents"))
    own = Window.partitionBy("client")
    cohort = lambda state: F.max(F.when(F.col("state") == state, F.col("cohort"))).over(own)
    users = users.withColumn("moved", F.coalesce(cohort(0) != cohort(1), F.lit(False)).cast("long"))
    segments = clients.where("client_id is not null").groupBy(F.col("client_id").cast("long").alias("client")).agg(F.min(segment_col).alias("segment"))
    return (
        users.join(segments, "client", "left")
        .groupBy("state", F.coalesce("segment", F.lit("")).alias("segment"), "cohort", "period")
        .agg(
            F.count("*").alias("users"), F.sum(F.crc32(F.col("client").cast("string").cast("binary"))).alias("users_crc32"),
            F.sum("moved").alias("moved"), F.sum("cents").alias("cents"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


#: crc32 of a decimal number, with the table of its 256 remainders.
_CRC_SQL = """CASE WHEN {0} IS NULL THEN 0 ELSE xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END"""
ORACLE_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t
), c AS (
  SELECT d.*, {_CRC_SQL.format("click_id")} AS h FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL) d, tab
), k AS (
  SELECT client_id, ts, kind, value, coalesce(arrived_at + CASE WHEN h % 3 = 0 THEN to_days((h % 100)::INTEGER) ELSE to_days(0) END < TIMESTAMP '2024-03-01 00:00:00', false) AS early FROM c
), s AS (
  SELECT 0 AS state, client_id, ts, kind, value FROM k WHERE early UNION ALL SELECT 1, client_id, ts, kind, value FROM k
), f AS (SELECT state, client_id, min(epoch_us(ts)) AS start FROM s WHERE kind = 'purchase' GROUP BY ALL),
m AS (
  SELECT state, client_id, start, floor(floor(start / 86400000000.0) / 3)::BIGINT AS cohort,
         count(*) OVER (PARTITION BY client_id) = 2 AS both_states FROM f
), v AS (SELECT client_id, both_states AND min(cohort) <> max(cohort) AS moved FROM m GROUP BY client_id, both_states),
u AS (
  SELECT s.state, s.client_id, m.cohort, (epoch_us(s.ts) - m.start) // 259200000000 AS period, sum(coalesce(floor(100 * value + 0.5), 0))::BIGINT AS cents
  FROM s JOIN m ON s.state = m.state AND s.client_id = m.client_id AND epoch_us(s.ts) >= m.start GROUP BY ALL
), g AS (SELECT client_id, min(city) AS city FROM clients GROUP BY client_id)
SELECT state::INTEGER AS state, coalesce(g.city, '') AS segment, cohort, period, count(*)::BIGINT AS users,
       sum({_CRC_SQL.format("u.client_id")})::BIGINT AS users_crc32, sum(CASE WHEN moved THEN 1 ELSE 0 END)::BIGINT AS moved, sum(cents)::BIGINT AS cents
FROM u JOIN v ON u.client_id = v.client_id LEFT JOIN g ON u.client_id = g.client_id, tab GROUP BY ALL
"""
