"""The triple upsert as a keyed state machine: map state for edges and waiting events, timers for event time.

Events may arrive in any order within the watermark: they wait in the state until the watermark has
passed their time, when a timer releases them in order, so the result does not depend on how
they were dealt into batches.  Each change of an edge is emitted; the last version of an edge
(by ``version``) is what the batch form says of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.operators.facts import step

EDGE = "relation string, target long, negated boolean, confidence double, valid_from long, valid_until long, strength double, state string"
OUT_SCHEMA = f"subject long, edge long, version long, action string, {EDGE}"


class UpsertState(StatefulProcessor):
    """State of one subject and relation: ``live`` edges by (target, serial), ``waiting`` events by time, and two counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "target long, serial long", f"edge long, {EDGE}")
        self.waiting = handle.getMapState("waiting", "us long, nth long", "target long, negated boolean, confidence double")
        self.counters = handle.getValueState("counters", "events long, versions long")

    def _counters(self) -> tuple[int, int]:
        return tuple(self.counters.get()) if self.counters.exists() else (0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events, versions = self._counters()
        for frame in rows:
            for row in frame.itertuples(index=False):
                events += 1
                self.waiting.updateValue((int(row.us), events), (int(row.target), bool(row.negated), None if pd.isna(row.confidence) else float(row.confidence)))
                # a timer is in milliseconds and must not come before the event
                self.handle.registerTimer(-(-int(row.us) // 1000))
        self.counters.update((events, versions))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        subject, relation = key
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(
            ((us, target, negated, confidence is not None, confidence or 0.0, nth) for (us, nth), (target, negated, confidence) in self.waiting.iterator() if us <= until)
        )
        if not due:
            return
        events, versions = self._counters()
        names = [c.split()[0] for c in EDGE.split(", ")]
        held, number, stored = {}, {}, {}
        for at, (edge, *values) in self.live.iterator():
            held[tuple(at)] = dict(zip(names, values, strict=True))
            number[id(held[tuple(at)])] = edge
            stored[tuple(at)] = True
        out, kept = [], []
        for us, target, negated, known, confidence, nth in due:
            events += 1
            for action, edge in step(held, events, relation, target, negated, confidence if known else None, us):
                kept.append(edge)  # an id stands for an edge only while the edge is there
                versions += 1
                out.append((subject, number.setdefault(id(edge), events), versions, action, *[edge[c] for c in names]))
            self.waiting.removeKey((us, nth))
        for at in stored:
            if at not in held:
                self.live.removeKey(at)
        for at, edge in held.items():
            self.live.updateValue(at, (number[id(edge)], *[edge[c] for c in names]))
        self.counters.update((events, versions))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])
        made["valid_until"] = made["valid_until"].astype("Int64")
        yield made

    def close(self) -> None:
        pass


def upsert_stream(triples: DataFrame, late: str = "1 hour") -> DataFrame:
    """Versions of edges from a stream of triples (subject, relation, target, negated, confidence, ts); needs the RocksDB state store."""
    events = triples.withWatermark("ts", late).select("subject", "relation", "target", "negated", "confidence", F.unix_micros("ts").alias("us"), "ts")
    return events.groupBy("subject", "relation").transformWithStateInPandas(
        statefulProcessor=UpsertState(), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def latest(versions: DataFrame) -> DataFrame:
    """The edges after all versions: the last one of each."""
    names = [c.split()[0] for c in EDGE.split(", ")]
    return versions.groupBy("subject", "relation", "edge").agg(F.max_by(F.struct(*names), "version").alias("x")).select("subject", "x.*")
