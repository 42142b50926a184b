"""Graph steps and deletion on random graphs against plain Python: each reads its tables once, not once a hop."""

import math
import random

import pytest
from test_deletion import SCHEMAS
from test_deletion import plain as plain_deletion
from test_deletion import rows as rows_of
from test_legs import DAY

from engram.operators import deletion, graph, legs

NOW = 1000 * DAY
EDGE = "edge_id long, source long, target long, relation string, strength double, confidence double, negated boolean, valid_from long, valid_until long, batch long"


def some_edges(rng, n, nodes):
    day = lambda: rng.randrange(900, 1100) * DAY
    return [
        (e, rng.randrange(nodes), rng.randrange(nodes), rng.choice("xy"), rng.choice((None, -1.0, 0.4, 0.8, 2.0)), rng.choice((None, 0.9)), rng.choice((None, False, False, True)), rng.choice((None, day())), rng.choice((None, None, day())), rng.choice((None, 1, 2, 3)))
        for e in range(n)
    ]


def plain_walk(edges, anchors, queries, denied):
    out = {}
    for q, mode, _, t1, batches, shunned in queries:
        at = t1 if mode in ("as_of", "range") else None
        mine = {a for p, a in anchors if p == q}
        shut = mine | {n for p, n in denied if p == q}
        ways = []
        for _, a, b, _, strength, confidence, negated, since, until, batch in edges:
            ok = until is None if at is None else (since is None or since <= at) and (until is None or until > at)
            ok = ok and not negated and (batches is None or batch in batches) and (shunned is None or (batch is not None and batch not in shunned))
            if ok:
                start = since if at is not None else NOW if since is None else min(since, NOW)
                fresh = 1 if start is None else 1 + 0.3 * math.exp(-abs(start - (NOW if at is None else at)) / DAY / 30)
                ways += [(a, b, (strength or 0) * (1 if confidence is None else confidence) * fresh), (b, a, (strength or 0) * (1 if confidence is None else confidence) * fresh)]
        for anchor in mine - {n for p, n in denied if p == q}:
            seen = {anchor: 0}
            for depth, floor in ((1, 0.5), (2, 1.0), (3, 1.0)):
                new = {b for a, b, trust in ways if seen.get(a) == depth - 1 and trust >= floor} - shut - set(seen)
                seen |= dict.fromkeys(new, depth)
            out |= {(q, anchor, node): depth for node, depth in seen.items()}
    return out


def scans(monkeypatch, module):
    """For each frame that a module cuts, the files that its plan reads."""
    read, plain_cut = [], module.cut

    def cut(df):
        read.append(df.inputFiles())
        return plain_cut(df)

    monkeypatch.setattr(module, "cut", cut)
    return read


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_walk_reads_its_edges_once(spark, tmp_path, monkeypatch, most):
    rng = random.Random(3)
    rows = some_edges(rng, 250, 60)
    window = lambda: (900 * DAY, rng.randrange(950, 1050) * DAY)
    queries = [(q, mode, *(window() if mode in ("as_of", "range") else (None, None)), rng.choice((None, [1, 2])), rng.choice((None, [3]))) for q in range(12) for mode in [rng.choice(("current", "as_of", "range", "evolution"))]]
    anchors = sorted({(q, rng.randrange(60)) for q in range(12) for _ in range(3)})
    denied = [(q, rng.randrange(60)) for q in range(12) for _ in range(3)]
    spark.createDataFrame(rows, EDGE).write.parquet(f"{tmp_path}/known_edges")
    edges = spark.read.parquet(f"{tmp_path}/known_edges")
    asked = spark.createDataFrame(queries, "query_id long, mode string, t0 long, t1 long, batches array<long>, denied array<long>")
    begun, shut = spark.createDataFrame(anchors, "query_id long, anchor long"), spark.createDataFrame(denied, "query_id long, node long")
    monkeypatch.setattr(legs, "SMALL", most)
    monkeypatch.setattr(legs, "KEYS", most, raising=False)
    read = scans(monkeypatch, legs)
    walk = legs.scoped_walk(edges, begun, asked, NOW, shut)
    want = plain_walk(rows, anchors, queries, denied)
    assert {(r.query_id, r.anchor, r.node): r.depth for r in walk.collect()} == want and walk.count() == len(want) > 100 and set(want.values()) == {0, 1, 2, 3}
    assert sum(map(bool, read)) == 1
    del read[:]
    notes = legs.graph_fragments(edges, begun.selectExpr("query_id", "anchor", "0 as nth", "array('x') as relations"), asked, walk, NOW)
    assert notes.where("leg = 'codex'").count() == sum(d == 0 for d in want.values()) and notes.where("leg = 'timeline'").count() > 5
    assert sum(map(bool, read)) == 1 and not notes.inputFiles()


def test_a_traversal_holds_one_row_for_64_seeds(spark, monkeypatch):
    rng = random.Random(9)
    node = lambda: rng.choice((None, *range(-40, 160), *range(20)))
    rows = [(e, node(), node(), "x", rng.choice((None, 0.3, 0.8, 2.0, 2.0)), rng.choice((None, 0.9)), rng.random() < 0.1, NOW, rng.choice((None, None, 5)), 1) for e in range(2500)]
    seeds = [*range(-5, 125), 7, 999]
    held, plain_cut = [], graph.cut

    def cut(df):
        out = plain_cut(df)
        held.append(out.count() if "depth" in out.columns else 0)
        return out

    monkeypatch.setattr(graph, "cut", cut)
    frame = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(3)
    got = sorted((r.seed, r.node, r.depth) for r in graph.traverse(spark.createDataFrame(rows, EDGE), frame, NOW).collect())
    direct, deep = {}, {}
    for _, a, b, _, strength, confidence, negated, _, until, _ in rows:
        if until is None and not negated and strength is not None and a is not None and b is not None:
            for x, y in ((a, b), (b, a)):
                if strength * (confidence or 1.0) * 1.3 >= 0.5:
                    direct.setdefault(x, set()).add(y)
                if strength >= 1.0:
                    deep.setdefault(x, set()).add(y)
    want = [(7, 7, 0)]  # a seed that is asked twice
    for seed in set(seeds):
        seen, last = {seed}, {seed}
        want.append((seed, seed, 0))
        for n, ways in enumerate((direct, deep, deep), 1):
            last = {y for x in last for y in ways.get(x, ())} - seen
            seen |= last
            want += [(seed, x, n) for x in last]
    assert got == sorted(want)
    most = len({x for _, x, _ in want})
    assert max(held) <= most * 5 < max(sum(d == n for _, _, d in want) for n in (1, 2, 3))


def test_a_level_of_a_deletion_holds_only_what_waits(spark, monkeypatch):
    t = rows_of(4)
    # patterns on patterns, a chain of 12 levels and a ring that nothing bears
    turn = next(n for n, c, _ in t["turns"] if c == 1)
    t["evidence"] += [(100, "turn", turn), *((p, "pattern", p - 1) for p in range(101, 112)), (120, "pattern", 121), (121, "pattern", 120), (130, None, 3), (131, "turn", None), (111, "turn", turn), (100, "turn", turn)]
    frames = {name: spark.createDataFrame(t[name], schema) for name, schema in SCHEMAS.items()}
    held, plain_cut = [], deletion.cut

    def cut(df):
        out = plain_cut(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(deletion, "cut", cut)
    doomed = spark.createDataFrame([(1,), (3,), (4,)], "conversation_id long")
    planned = deletion.plan(deletion.Store(**frames), doomed)
    want = plain_deletion(t, {1, 3, 4})
    assert {name: {tuple(x) if len(x) > 1 else x[0] for x in ids.collect()} for name, ids in planned.items()} == want
    assert {x["store"]: x["n"] for x in deletion.manifest(planned).collect()} == {name: len(x) for name, x in want.items()}
    assert {*range(100, 112)} <= want["patterns"] and not want["patterns"] & {120, 121, 130, 131}
    # frames as large as all turns that go: not one a level
    assert sum(n >= len(want["turns"]) for n in held) <= 8 and len(held) > 30
    monkeypatch.setattr(deletion, "KEYS", -1, raising=False)
    again = deletion.plan(deletion.Store(**frames), doomed)
    assert {name: {tuple(x) if len(x) > 1 else x[0] for x in ids.collect()} for name, ids in again.items()} == want
