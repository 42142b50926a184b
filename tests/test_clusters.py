"""Cluster merge and matching without reuse against plain versions."""

import numpy as np
import pytest

from engram.operators import clusters as cl


def plain_merge(rows):
    live = {i: (g, a, n, np.array(v) * n, set(c)) for g, i, a, n, v, c in rows if v is not None and np.linalg.norm(v) > 0}
    into = {i: i for _, i, *_ in rows}
    while True:
        wants = {}
        for i, (g, a, _, s, c) in live.items():
            older = sorted((b, j) for j, (h, b, *_) in live.items() if h == g and (b, j) < (a, i))
            for _, j in older:
                t, d = live[j][3], live[j][4]
                cosine = round(float(s @ t / np.linalg.norm(s) / np.linalg.norm(t)), 9)
                if cosine >= cl.RAW and cosine + min(cl.BONUS_MOST, cl.BONUS_EACH * len(c & d)) >= cl.ADJUSTED:
                    wants[i] = j
                    break
        if not wants:
            return into
        for i, j in wants.items():
            if j not in wants:
                g, a, n, s, c = live[j]
                live[j] = (g, a, n + live[i][2], s + live[i][3], c | live[i][4])
                del live[i]
                into = {k: j if x == i else x for k, x in into.items()}


@pytest.mark.parametrize("block_rows", [4, 512])
def test_merge_equals_the_plain_version(spark, block_rows):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((4, 6))
    rows = []
    for n in range(70):
        v = centres[n % 4] + rng.standard_normal(6) * rng.choice((0.1, 0.35, 0.8))
        rows.append((int(n % 3 == 0), n, int(rng.integers(0, 50)), int(rng.integers(1, 4)), (v / np.linalg.norm(v)).tolist(), [str(x) for x in rng.integers(0, 6, 2)]))
    rows += [(0, 100, 1, 1, None, []), (0, 101, 0, 1, [0.0] * 6, ["1"]), (5, 102, 0, 1, [1.0] * 6, [])]
    table = spark.createDataFrame(rows, "group int, id long, age int, n int, vector array<double>, cast array<string>")
    got = {r["id"]: r["into"] for r in cl.merge_clusters(table, block_rows=block_rows).collect()}
    want = plain_merge(rows)
    assert got == want and len(set(want.values())) < 50
    assert cl.merge_clusters(table.limit(0)).count() == 0


def test_matching_equals_the_plain_version(spark):
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    entities = [(n, [f"Name{n % 9}", f"alias{n}"], unit(rng.standard_normal(5)).tolist()) for n in range(60)] + [(60, ["only"], None)]
    mentions = []
    for p in range(12):
        for n in range(int(rng.integers(1, 7))):
            near = np.array(entities[int(rng.integers(0, 8))][2]) + rng.standard_normal(5) * 0.12
            mentions.append((p, n * 10, ["name3 ", "ALIAS7", "none", "only"][int(rng.integers(0, 4))], unit(near).tolist() if rng.random() < 0.8 else None))
    want = set()
    for p in range(12):
        used = set()
        for _, nth, name, v in sorted(x for x in mentions if x[0] == p):
            scored = [] if v is None else sorted((-round(float(np.dot(v, e)), 9), i) for i, _, e in entities if e is not None and i not in used)
            if scored and -scored[0][0] >= cl.MATCH_FLOOR:
                best, score = scored[0][1], -scored[0][0]
            else:
                named = [i for i, names, _ in entities if name.strip().lower() in [x.lower() for x in names]]
                best, score = (min(named), None) if named and min(named) not in used else (None, None)
            if best is not None:
                used.add(best)
                want.add((p, nth, best, score))
    m = spark.createDataFrame(mentions, "prompt long, nth int, name string, vector array<double>")
    e = spark.createDataFrame(entities, "id long, names array<string>, vector array<double>")
    got = {tuple(r) for r in cl.match_mentions(m, e).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(want) > 20


def test_entities_are_hashed_where_they_lie(spark, tmp_path):
    """No word is shuffled on the way to a text's vector, which is the sum of its distinct words' places."""
    import hashlib

    from engram.plans import entities as en

    docs = [(1, "en", "a b c d e f g h a"), (2, None, None), (3, "de", " 12 -"), (4, "en", "Äpfel sind GRÜN")]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    real, en.cut = en.cut, lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1]
    try:
        rows = {r["id"]: r for r in en.entities(spark, str(tmp_path)).collect()}
    finally:
        en.cut = real
    assert plans and "Exchange" not in plans[0]

    def vector(words):
        v = [0.0] * en.WIDTH
        for w in set(words):
            d = hashlib.md5(w.encode()).hexdigest()
            v[int(d[:4], 16) % en.WIDTH] += 1.0 if d[4] < "8" else -1.0
        return v

    assert rows[1]["vector"] == vector("abcdefgh") and rows[4]["vector"] == vector(["äpfel", "sind", "grün"])
    assert rows[2]["vector"] is None and rows[3]["vector"] is None and rows[1]["names"] == ["a b c d", "f g h a"] and rows[4]["names"] == []
