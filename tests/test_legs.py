"""Scoped search and the graph leg against plain Python, with random scopes and hostile rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import legs

DAY = 86_400_000_000
TURN = "id long, vector array<double>, us long, conversation long, clusters array<long>, decay double, is_archived boolean, is_private boolean"
SCOPE = "query_id long, vector array<double>, mode string, t0 long, t1 long, centre long, boost double, tau double, conversations array<long>, excluded array<long>, clusters array<long>, excluded_clusters array<long>"


def some(rng, top):
    return [rng.randrange(top) for _ in range(rng.randrange(3))]


def turn(rng, n):
    vector = [float(rng.randrange(-3, 4)) for _ in range(3 if n % 9 == 0 else 4)]  # few values: many ties
    vector = None if n % 31 == 0 else [math.nan, 1.0, 1.0, 1.0] if n % 37 == 0 else vector
    return (
        n, vector, None if n % 41 == 0 else rng.randrange(100) * DAY, rng.choice([None, *range(6)]), rng.choice([None, some(rng, 4), some(rng, 4)]),
        rng.choice([None, 0.0, 0.1, 0.2, 0.5, 1.0]), rng.choice([None, True, False, False]), rng.choice([None, True, False, False]),
    )


def query(rng, n):
    window = rng.random() < 0.5
    lists = [rng.choice([None, None, some(rng, 6)]) for _ in range(4)]
    return (n, [float(rng.randrange(-3, 4)) for _ in range(4)], "range" if window else rng.choice(["current", "evolution"]), 20 * DAY if window else None, 70 * DAY if window else None, 50 * DAY, rng.choice([0.0, 0.25]), 30.0, *lists)


def plain_search(turns, queries, k, decayed, newest):
    out = []
    for q in queries:
        found = []
        for t in turns:
            n, v, us, conversation, clusters, decay, archived, private = t
            if v is None or us is None or len(v) != len(q[1]) or any(x is None or not math.isfinite(x) for x in v):
                continue
            clusters = clusters or []
            _, vector, mode, t0, t1, centre, boost, tau, own, out_, want, unwanted = q
            ok = decay is not None and (decay > 0.2 and not archived if mode == "current" else decay > 0)
            ok = ok and (t0 is None or us >= t0) and (t1 is None or us < t1)
            ok = ok and (not private if own is None else conversation in own and conversation is not None)
            ok = ok and (out_ is None or (conversation is not None and conversation not in out_))
            ok = ok and (want is None or not clusters or any(c in want for c in clusters)) and not any(c in (unwanted or []) for c in clusters)
            if ok:
                size = np.linalg.norm(v) * np.linalg.norm(vector)
                near = float(np.dot(v, vector) / size) if size else 0.0
                score = round(near * (decay if decayed else 1) * (1 + boost * math.exp(-abs(us - centre) / DAY / tau)), 6)
                found.append((-score, -us if newest else 0, n))
        out += [(q[0], n, rank) for rank, (_, _, n) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("decayed", "newest", "passes"), [(True, False, 1), (False, True, 3)])
def test_scoped_search(spark, monkeypatch, decayed, newest, passes):
    rng = random.Random(7)
    turns, queries = [turn(rng, n) for n in range(400)], [query(rng, n) for n in range(40)]
    if passes > 1:
        monkeypatch.setattr(vectors, "QUERY_BYTES", 2_500)
        monkeypatch.setattr(vectors, "CELLS", 100)
    found = vectors.scoped_topk(spark.createDataFrame(turns, TURN).repartition(3), spark.createDataFrame(queries, SCOPE), 9, "id", "vector", decayed=decayed, newest=newest)
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == plain_search(turns, queries, 9, decayed, newest)


def test_scoped_search_of_nothing(spark):
    rng = random.Random(1)
    turns, queries = spark.createDataFrame([turn(rng, n) for n in range(5)], TURN), spark.createDataFrame([query(rng, 0)], SCOPE)
    assert vectors.scoped_topk(turns.where("false"), queries, 3, "id", "vector").count() == 0
    assert vectors.scoped_topk(turns, queries.where("false"), 3, "id", "vector").count() == 0


def test_cold_rows_of_one_distance_come_newest_first(spark):
    cold = spark.createDataFrame(
        [(n, [1.0, 0.0] if n < 6 else None, us, 1, False, text) for n, us, text in [(0, 5, ""), (1, 9, ""), (2, 9, ""), (3, 7, ""), (4, 1, ""), (5, 99, ""), (6, 8, "an Apple"), (7, 8, "a pear"), (8, 6, None)]],
        "id long, vector array<double>, us long, conversation long, is_private boolean, text string",
    )
    asked = spark.createDataFrame(
        [(1, [1.0, 0.0], "range", 0, 50, None, None, ["apple"]), (2, [0.0, 1.0], "range", 0, 50, None, None, []), (3, [1.0, 0.0], "current", 0, 50, None, None, []), (4, [1.0, 0.0], "evolution", None, None, None, None, []), (5, [1.0, 0.0], "range", 0, 50, [2], None, [])],
        "query_id long, vector array<double>, mode string, t0 long, t1 long, conversations array<long>, excluded array<long>, keywords array<string>",
    )
    found = [(r.query_id, r.id, r.distance) for r in legs.cold_leg(cold, asked, 1000, limit=4).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0), (1, 0, 0.0), (2, 1, 1.0), (2, 2, 1.0), (2, 6, 1.0), (2, 7, 1.0)]


def test_walk_stays_in_scope(spark):
    edge = lambda n, a, b, batch=1, strength=5.0, until=None, negated=False: (n, a, b, "uses", strength, None, negated, 0, until, batch)
    edges = spark.createDataFrame(
        [edge(1, 1, 2), edge(2, 3, 2), edge(3, 3, 4), edge(4, 4, 5), edge(5, 1, 6, batch=2), edge(6, 1, 7, negated=True), edge(7, 1, 8, until=10), edge(8, 1, 9, strength=0.1), edge(9, 2, 10, strength=0.7), edge(10, 1, 11, strength=0.7), edge(11, 1, 12), edge(12, 12, 13), edge(13, 1, 14, batch=None)],
        "edge_id long, source long, target long, relation string, strength double, confidence double, negated boolean, valid_from long, valid_until long, batch long",
    )
    queries = spark.createDataFrame(
        [(1, "current", None, None, [1], None), (2, "as_of", 0, 5, None, [2]), (3, "current", None, None, None, None), (4, "current", None, None, None, None)],
        "query_id long, mode string, t0 long, t1 long, batches array<long>, denied array<long>",
    )
    anchors = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 2), (4, 1)], "query_id long, anchor long")
    denied = spark.createDataFrame([(1, 12), (4, 1)], "query_id long, node long")
    walk = legs.scoped_walk(edges, anchors, queries, 1000 * DAY, denied)
    found = {}
    for r in walk.collect():
        found.setdefault((r.query_id, r.anchor), {})[r.node] = r.depth
    assert found == {
        (1, 1): {1: 0, 2: 1, 11: 1, 3: 2, 4: 3},
        (2, 1): {1: 0, 2: 1, 8: 1, 11: 1, 12: 1, 3: 2, 13: 2, 4: 3},
        (3, 1): {1: 0, 6: 1, 11: 1, 12: 1, 14: 1, 13: 2},
        (3, 2): {2: 0, 3: 1, 10: 1, 4: 2, 5: 3},
    }
    asked = anchors.selectExpr("query_id", "anchor", "anchor as nth", "array('uses') as relations")
    rows = {(r.query_id, r.leg, r.anchor): r for r in legs.graph_fragments(edges, asked, queries, walk, 1000 * DAY).collect()}
    assert {k for k in rows if k[1] == "timeline"} == {(1, "timeline", 1), (2, "timeline", 1), (3, "timeline", 1)}
    note = rows[(1, "codex", 1)]
    assert (note.reached, note.score) == (4, 1.75)
    assert note.text.startswith("# 1\n-> uses 2\nnot -> uses 7\n-> uses 12\n-> uses 11\n-> uses 9\nfact -> uses 2")
    assert rows[(3, "timeline", 1)].score == round(0.9 * rows[(3, "codex", 1)].score, 6)
    assert "1970-01-01 to 1970-01-01 -> uses 8" in rows[(3, "timeline", 1)].text


def test_scope_of_a_creative_query(spark):
    rows = spark.createDataFrame([(1, "current", None, None, True), (2, "as_of", 0, 100 * DAY, True), (3, "range", 0, 10, False), (4, "as_of", None, 5, False), (5, "evolution", 3, 9, False)], "query_id long, mode string, t0 long, t1 long, creative boolean")
    found = {r.query_id: (r.centre, r.boost, r.tau, r.t0, r.t1) for r in legs.scopes(rows, 7).select("query_id", "centre", "boost", "tau", "t0", "t1").collect()}
    assert found == {1: (7, 0.0, 30.0, None, None), 2: (50 * DAY, 0.25, 50.0, 0, 100 * DAY), 3: (7, 0.0, 30.0, 0, 10), 4: (7, 0.25, 30.0, None, None), 5: (7, 0.0, 30.0, None, None)}
    assert rows.where(F.col("mode") == "current").count() == 1
