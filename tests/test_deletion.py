"""Deletion against a plain version; the dry run says what the deletion does."""

import random

from pyspark.sql import functions as F

from engram.operators import deletion

SCHEMAS = {
    "turns": "turn_id long, conversation_id long, batch long", "edges": "edge_id long, source long, target long, batch long, valid_until long, derived boolean", "added": "edge_id long, batch long",
    "entities": "entity long, derived boolean, authored boolean", "members": "cluster_id long, turn_id long", "chunks": "chunk_id long, turn_id long", "evidence": "pattern_id long, kind string, id long",
}


def rows(seed):
    r = random.Random(seed)
    turns = [(n, r.randrange(8), r.choice((None, n))) for n in range(80)]
    edges = [(n, r.randrange(30), r.randrange(30), r.randrange(80), r.choice((None, None, None, 5)), r.random() < 0.1) for n in range(60)]
    added = [(e[0], e[3]) for e in edges] + [(r.randrange(60), r.choice((None, r.randrange(80)))) for _ in range(25)]
    entities = [(n, r.random() < 0.15, r.random() < 0.15) for n in range(30)]
    members = [(r.randrange(25), r.randrange(80)) for _ in range(70)]
    chunks = [(n, r.randrange(80)) for n in range(40)]
    evidence = [(n, *r.choice((("turn", r.randrange(80)), ("turn", r.randrange(80)), ("pattern", r.randrange(max(1, n)) if n else 29)))) for n in range(30) for _ in range(r.randrange(1, 3))]
    return {"turns": turns, "edges": edges, "added": added, "entities": entities, "members": members, "chunks": chunks, "evidence": evidence}


def plain(t, conversations):
    gone = {n for n, c, _ in t["turns"] if c in conversations}
    batches = {b for n, _, b in t["turns"] if n in gone and b is not None}
    stated = {e[0] for e in t["edges"] if e[3] in batches and e[4] is None and not e[5]}
    edges = {e for e in stated if not any(x == e and b is not None and b not in batches for x, b in t["added"])}
    touched = {x for e in t["edges"] if e[0] in edges for x in e[1:3]}
    holding = {x for e in t["edges"] if e[4] is None and e[0] not in edges for x in e[1:3]}
    entities = {n for n, derived, authored in t["entities"] if n in touched - holding and not derived and not authored}
    links = {m for m in t["members"] if m[1] in gone}
    clusters = {c for c, _ in links} - {c for c, n in t["members"] if n not in gone}
    fallen = {("turn", n) for n in gone}
    while True:
        more = {("pattern", p) for p, _, _ in t["evidence"] if all((k, i) in fallen for q, k, i in t["evidence"] if q == p)} - fallen
        if not more:
            break
        fallen |= more
    return {
        "turns": gone, "chunks": {c for c, n in t["chunks"] if n in gone}, "edges": edges, "entities": entities, "cluster_links": links, "clusters": clusters,
        "evidence": {e for e in t["evidence"] if e[1:] in fallen}, "patterns": {p for k, p in fallen if k == "pattern"}, "kept_edges": stated - edges,
    }


def test_plan_equals_the_plain_version_and_what_apply_does(spark):
    t = rows(1)
    store = deletion.Store(**{name: spark.createDataFrame(t[name], schema) for name, schema in SCHEMAS.items()})
    planned = deletion.plan(store, spark.createDataFrame([(1,), (3,), (3,), (4,), (77,)], "conversation_id long"))
    want = plain(t, {1, 3, 4, 77})
    got = {name: [tuple(x) if len(x) > 1 else x[0] for x in ids.collect()] for name, ids in planned.items()}
    assert {name: set(x) for name, x in got.items()} == want and all(len(x) == len(set(x)) for x in got.values())
    assert all(want.values())
    counts = {x["store"]: x["n"] for x in deletion.manifest(planned).collect()}
    assert counts == {name: len(x) for name, x in want.items()}
    after = deletion.apply(store, planned, 99)
    assert after.turns.count() == 80 - len(want["turns"]) and after.entities.count() == 30 - len(want["entities"])
    assert {r["edge_id"] for r in after.edges.where("valid_until = 99").collect()} == want["edges"]
    again = deletion.plan(after, spark.createDataFrame([(1,), (3,), (4,)], "conversation_id long"))
    assert deletion.manifest(again).where(F.col("n") > 0).count() == 0
