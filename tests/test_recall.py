"""Fusion, bonuses, caps, forms and budget of the whole way of a prompt against plain Python."""

import random

from pyspark.sql import functions as F

from engram.operators import recall

FIND = "query_id long, leg string, ref long, rank int, key string, text string, degrade string, abstract string, conversation long, origin long, us long"


def finds_of(rng):
    rows = []
    for q in range(4):
        for leg in recall.ORDER[:6]:
            for rank, n in enumerate(rng.sample(range(40), 12), 1):
                text = f"text {n // 2 if leg != 'codex' else 'graph'} {n % 7 if leg == 'codex' else ''}"  # two refs may share a text
                rows.append((q, leg, n * 8, rank, text, text, None, None, None if n % 5 == 0 else n % 3, None if n % 4 == 0 else n // 3, None))
    return rows


def test_fusion_caps_and_bonus(spark):
    rng = random.Random(3)
    rows = finds_of(rng)
    weights = {(q, leg): rng.random() for q in range(4) for leg in recall.ORDER[:4]}
    fused = recall.fuse_weighted(spark.createDataFrame(rows, FIND), spark.createDataFrame([(q, leg, w) for (q, leg), w in weights.items()], "query_id long, leg string, weight double"))
    plain = {}
    for q, leg, ref, rank, key, *_ in rows:
        own = plain.setdefault((q, key), [0.0, (99, 0, 0, "")])
        own[0] += weights.get((q, leg), 1.0) / (60 + rank)
        own[1] = min(own[1], (recall.ORDER.index(leg), rank, ref, leg))
    want = sorted((q, first[2], first[3], round(score, 9)) for (q, _), (score, first) in plain.items())
    assert sorted((r.query_id, r.ref, r.leg, round(r.score, 9)) for r in fused.collect()) == want


def test_chosen_caps(spark):
    rows = finds_of(random.Random(5))
    finds = spark.createDataFrame(rows, FIND)
    queries = spark.createDataFrame([(q, ["graph"], 1 if q else None, [], []) for q in range(4)], "query_id long, keywords array<string>, own long, intents array<string>, topics array<string>")
    shares = spark.createDataFrame([(n, 0.05 if n < 2 else 0.9, 30) for n in range(14)], "id long, share double, total long")
    kept = recall.chosen(finds, queries, shares).collect()
    by_text = {(q, key) for q, _, _, _, key, *_ in rows}
    assert len(kept) == len({(r.query_id, r.text) for r in kept}) and {(r.query_id, r.text) for r in kept} <= by_text
    for q in range(4):
        own = 1 if q else None
        for c in {r.conversation for r in kept if r.query_id == q}:
            if c is not None and c != own:
                assert sum(r.query_id == q and r.conversation == c for r in kept) <= 3
        for o in {r.origin for r in kept if r.query_id == q and r.origin is not None}:
            assert sum(r.query_id == q and r.origin == o for r in kept) <= 2
    # a short text loses .7; a keyword and a new turn add one each
    plain = {(r.query_id, r.ref, r.leg): r.score for r in recall.fuse_weighted(finds, recall.rt.leg_weights(queries.select("query_id", "intents", "topics"))).collect()}
    for r in kept:
        new = r.origin is not None and r.origin < 2
        raised = max(-0.9, -0.7 + (1.0 if "graph" in r.text else 0.0) + (1.0 if new else 0.0))
        assert abs(r.score - round(plain[r.query_id, r.ref, r.leg] * (1 + raised), 9)) < 2e-9


def test_forms_and_budget(spark):
    long = " ".join(f"word{n}." for n in range(700))
    turns = spark.createDataFrame(
        [(1, long, "a summary of word1", "short", False, 1, 86_400_000_000), (2, long, None, None, True, 1, 0), (3, None, None, None, None, None, None), (4, "plain text", None, None, None, 2, 0)],
        "id long, raw string, summary string, abstract string, inject_raw boolean, conversation long, us long",
    )
    queries = spark.createDataFrame([(1, ["word5"], [], [1.0, 0.0], 60), (2, ["none"], ["Ideation"], [1.0, 0.0], 10_000)], "query_id long, keywords array<string>, intents array<string>, vector array<double>, budget long")
    finds = spark.createDataFrame([(q, n) for q in (1, 2) for n in (1, 2, 3, 4)], "query_id long, id long")
    forms = recall.turn_forms(finds, turns, queries)
    told = {(r.query_id, r.id): r for r in forms.collect()}
    assert set(told) == {(q, n) for q in (1, 2) for n in (1, 2, 4)}  # a turn without text has no form
    assert told[1, 1].text == "[1970-01-02] " + long  # untrusted summary; a keyword allows for 1,500 words
    assert told[2, 2].text == "[1970-01-01] " + " ".join(f"word{n}." for n in range(500))
    assert told[1, 4].text == "[1970-01-01] plain text"
    rows = recall.turn_finds("bm25", finds.withColumn("rank", F.lit(1)), forms).withColumn("score", F.col("ref") / 100)
    taken = recall.within_budget(rows, queries, spark.createDataFrame([(1, [1.0, 0.0])], "origin long, found array<double>")).collect()
    for q, budget in ((1, 60), (2, 10_000)):
        assert 0 < sum(r.tokens for r in taken if r.query_id == q) <= budget
    assert {r.ref for r in taken if r.query_id == 1} == {32}
    assert {r.ref for r in taken if r.query_id == 2} == {8, 16, 32}
    assert recall.within_budget(rows.where("false"), queries, spark.createDataFrame([], "origin long, found array<double>")).count() == 0
