"""Triples become time-versioned edges: validity intervals by windows over the event log.

What one event does depends on the events of its subject before it, but only through few of
them: the last assertion of its relation, and whether a negation of that one's
target came after it.  Both are "last row before" questions, which are associative: a log is
dealt by ranges of (key, time), each range answers for itself, and what a range leaves open is
told by the ends of the ranges before it, one row a range and key.  So no subject
is ever gathered in one task, however hot it is.

``upsert_subject`` is the same rule event by event; the streaming form runs it per key.

Rules, in the order of (time, target, assertion before negation, confidence):

* A negation expires the asserted edge of its target and is stored as an edge of its own.
* An assertion of the target that holds adds 1 to its strength, keeps the larger
  confidence and makes a pending edge active.
* Another target of a property expires all edges of the relation and starts active with 3; of a
  single-valued relation it expires the one that holds and starts active with 3, or starts pending
  with 1 if none holds; a multi-valued relation holds all of them, each pending with 1 at first.

Triples without subject, relation, target or time are dropped; a null confidence counts as none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.relations import MULTI_VALUED, PROPERTIES
from engram.lineage import cut

ORDER = ("us", "target", "negated", "confidence")


def step(held: dict[tuple, dict], serial: int, relation: str, target, negated: bool, confidence, us: int, multi=MULTI_VALUED, properties=PROPERTIES) -> list[tuple[str, dict]]:
    """(action, edge) of one event on ``held``, the edges of its subject and relation that hold, which it changes.

    Edges are kept by (target, 0), negations by (target, serial): each of several stays.
    """
    done: list[tuple[str, dict]] = []
    new = {"relation": relation, "target": target, "negated": negated, "confidence": confidence, "valid_from": us, "valid_until": None, "strength": 1.0, "state": "active"}
    known = held.get((target, 0))

    def expire(key: tuple) -> None:
        edge = held.pop(key)
        edge["valid_until"] = us
        done.append(("expired", edge))

    if negated:
        if known:
            expire((target, 0))
        held[(target, serial)] = new
        return [*done, ("negated", new)]
    if known:
        known["strength"] += 1
        if confidence is not None and (known["confidence"] is None or confidence > known["confidence"]):
            known["confidence"] = confidence
        promoted, known["state"] = known["state"] == "pending", "active"
        return [("promoted" if promoted else "reinforced", known)]
    others = [key for key in held if relation in properties or key[1] == 0]
    if relation in properties:
        new["strength"] = 3.0
    elif relation not in multi and others:
        new["strength"] = 3.0
    else:
        others, new["state"] = [], "pending"
    for key in others:
        expire(key)
    held[(target, 0)] = new
    return [*done, ("added", new)]


def upsert_subject(triples: pd.DataFrame, multi=MULTI_VALUED, properties=PROPERTIES) -> pd.DataFrame:
    """The edges of one subject after its triples (relation, target, negated, confidence, us), event by event."""
    edges: list[dict] = []
    held: dict[str, dict[tuple, dict]] = {}
    for serial, t in enumerate(triples.sort_values(["us", "relation", "target", "negated", "confidence"]).itertuples(), 1):
        confidence = None if pd.isna(t.confidence) else t.confidence
        own = held.setdefault(t.relation, {})
        edges += [edge for action, edge in step(own, serial, t.relation, t.target, bool(t.negated), confidence, t.us, multi, properties) if action in ("added", "negated")]
    return pd.DataFrame(edges)


def dealt_log(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt by ranges of (keys, order), with their place ``at`` in that order and their ``block``; cut, since ranges are drawn from a sample."""
    came = F.monotonically_increasing_id().alias("__came")  # equal rows may be split, too
    ranged = rows.select("*", came).repartitionByRange(*keys, *order, "__came").sortWithinPartitions(*keys, *order, "__came")
    return cut(ranged.drop("__came").withColumn("at", F.monotonically_increasing_id())).withColumn("block", F.shiftright("at", 33))


def nearest(log: DataFrame, keys: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """``log`` with ``name``: the last value that is not null before each row among the rows of its keys, or the first after it.

    Windows stay inside (block, keys); the ends of the blocks of a key, one row each, carry over.
    """
    log = log.withColumn("__value", value)
    # looking ahead is looking back in the opposite order: a frame that ends with its partition would be read again for every row
    to = F.desc if ahead else F.asc
    before = lambda keys, place: Window.partitionBy(*keys).orderBy(to(place)).rowsBetween(Window.unboundedPreceding, -1)
    own, across = before(["block", *keys], "at"), before(keys, "block")
    spread = (F.min_by if ahead else F.max_by)("__value", F.when(F.col("__value").isNotNull(), F.col("at")))
    told = log.groupBy("block", *keys).agg(spread.alias("__end")).withColumn("__told", F.last("__end", ignorenulls=True).over(across))
    told = told.where("__told is not null").select("block", *keys, "__told")
    found = log.withColumn("__near", F.last("__value", ignorenulls=True).over(own)).join(told, ["block", *keys], "left")
    return found.withColumn(name, F.coalesce("__near", "__told")).drop("__near", "__told", "__value")


def replayed(triples: DataFrame, multi=MULTI_VALUED, properties=PROPERTIES) -> DataFrame:
    """Every event with what it met: ``edge`` (the place of the event that made the edge it speaks of), ``action``, ``start`` and where its edge ends."""
    key = ["subject", "relation", "slot"]
    rows = triples.select("subject", "relation", "target", F.coalesce("negated", F.lit(False)).alias("negated"), "confidence", "us").dropna(subset=["subject", "relation", "target", "us"])
    is_multi, is_property = F.col("relation").isin(*sorted(multi)), F.col("relation").isin(*sorted(properties))
    rows = rows.withColumn("slot", F.when(is_multi, F.col("target").cast("string")).otherwise(F.lit("")))
    log = dealt_log(rows, key, list(ORDER))
    asserts = ~F.col("negated")
    log = nearest(log, [*key, "target"], F.when(F.col("negated"), F.struct("at", "us")), "denied", ahead=True)
    log = nearest(log, key, F.when(asserts, F.struct("at", "target", F.col("denied.at").alias("denied"))), "last")
    holds = F.col("last").isNotNull() & (F.col("last.denied").isNull() | (F.col("last.denied") >= F.col("at")))
    opens = asserts & ~(holds & (F.col("last.target") == F.col("target")))
    log = cut(log.withColumns({"opens": opens, "start": F.when(is_property | (opens & holds), 3.0).otherwise(1.0)}))
    log = nearest(log, key, F.when(F.col("opens"), F.struct("at", "us")), "replaced", ahead=True)
    log = nearest(log, key, F.when(F.col("opens"), F.struct("at", "start")), "opened")
    first_again = (F.col("opened.at") == F.col("last.at")) & (F.col("opened.start") < 3)
    action = F.when(F.col("negated"), "negated").when(F.col("opens"), "added").when(first_again, "promoted").otherwise("reinforced")
    # an assertion ends with the first denial of its target or the first event that replaces it; a stored negation only with a new value of a property
    end = F.when(asserts, F.least("denied", "replaced")).when(is_property, F.col("replaced"))
    return log.withColumns({"action": action, "edge": F.when(F.col("opens") | F.col("negated"), F.col("at")).otherwise(F.col("opened.at")), "end": end})


def edges_of(events: DataFrame) -> DataFrame:
    """(subject, relation, target, negated, confidence, valid_from, valid_until, strength, state) of replayed events."""
    made = F.col("edge") == F.col("at")
    grouped = events.groupBy("subject", "relation", "edge").agg(
        F.max(F.when(made, F.struct("target", "negated", "us", "start", "end"))).alias("x"), F.max("confidence").alias("confidence"), (F.count("*") - 1).alias("again")
    )
    active = F.col("x.negated") | (F.col("x.start") >= 3) | (F.col("again") > 0)
    return grouped.select(
        "subject", "relation", "x.target", "x.negated", "confidence", F.col("x.us").alias("valid_from"), F.col("x.end.us").alias("valid_until"),
        (F.col("x.start") * F.when(F.col("x.negated"), F.lit(0)).otherwise(1) + F.col("x.negated").cast("int") + F.col("again")).cast("double").alias("strength"),
        F.when(active, "active").otherwise("pending").alias("state"),
    )


def journal_of(events: DataFrame) -> DataFrame:
    """(subject, relation, target, us, action): what every event did, and every expiry at the time of what caused it."""
    own = events.select("subject", "relation", "target", "us", "action")
    ended = events.where((F.col("edge") == F.col("at")) & F.col("end").isNotNull())
    return own.unionByName(ended.select("subject", "relation", "target", F.col("end.us").alias("us"), F.lit("expired").alias("action")))


def upsert(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, journal) of triples (subject, relation, target, negated, confidence, us)."""
    events = cut(replayed(triples))
    return edges_of(events), journal_of(events)
