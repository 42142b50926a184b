"""Near entities: all pairs by blocks, and buckets beyond."""

import numpy as np
import pytest

from engram.operators import duplicates as dup
from engram.operators import similar

ENTITIES = "id long, group string, names array<string>, vector array<double>"


def pairs_at(cosine, n, width=48, seed=5):
    """2n unit vectors: every two next to each other at about this cosine, all others far."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        v, w = rng.standard_normal((2, width))
        v /= np.linalg.norm(v)
        w -= v * (w @ v)
        rows += [v, v * cosine + w / np.linalg.norm(w) * np.sqrt(1 - cosine**2)]
    return np.array(rows)


def test_no_link_is_missed_where_all_pairs_are_compared(spark, monkeypatch):
    m = pairs_at(0.9001, 900)
    near = np.round(m @ m.T, 9) >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(dup, "BLOCK_ROWS", 500)
    table = spark.createDataFrame([(n, None if n % 4 < 2 else "t", [], v.tolist()) for n, v in enumerate(m)], ENTITIES)
    got = {r["id"]: (r["links"], r["component"]) for r in dup.duplicate_classes(table).collect()}
    assert got == {n: (1, n - n % 2) for n in range(1800)} and near.sum() == 1800


def test_buckets_find_nearly_all_beyond(spark, monkeypatch):
    m = pairs_at(0.9001, 500, seed=8)
    for name, value in (("EXACT_PAIRS", 0), ("BUCKET_ROWS", 60), ("BLOCK_ROWS", 50)):
        monkeypatch.setattr(dup, name, value)
    table = spark.createDataFrame([(n, "t", [], v.tolist()) for n, v in enumerate(m)], ENTITIES)
    got = {r["id"]: r["links"] for r in dup.duplicate_classes(table).collect()}
    assert set(got.values()) <= {0, 1} and sum(got.values()) >= 0.98 * 1000


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_near_pairs_equal_all_pairs(monkeypatch, spread):
    """Dense and sparse tiles, one block and two."""
    monkeypatch.setattr(similar, "TILE", 32)
    monkeypatch.setattr(similar, "PAIRS", 100)
    rng = np.random.default_rng(2)
    m = rng.standard_normal(20) + rng.standard_normal((150, 20)) * spread
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(m @ m.T, 9)
    for left, right, same in ((m, m, True), (m[:70], m[70:], False)):
        got = {(i, j): c for x in similar.near_pairs(left, right, 0.9, same) for i, j, c in zip(*(z.tolist() for z in x), strict=True)}
        c = np.triu(cosine, 1) if same else cosine[:70, 70:]
        assert got == pytest.approx({(int(i), int(j)): c[i, j] for i, j in np.argwhere(c >= 0.9)}, abs=1e-8)


def test_joining_joins_what_a_walk_joins():
    rng = np.random.default_rng(4)
    label, kept, parent = np.arange(400), [], list(range(400))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for _ in range(5):
        a, b = rng.integers(0, 400, (2, 60))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
        label, p, q = similar.joining(label, a, b)
        kept += list(zip(p.tolist(), q.tolist(), strict=True))
    assert label.tolist() == [top(n) for n in range(400)]
    assert len(kept) == 400 - len(set(label.tolist()))


def test_proposals_take_every_pair(spark, monkeypatch):
    """Of all pairs, also those without a group; and the best ones of buckets."""
    m = pairs_at(0.9001, 700, seed=8)
    table = spark.createDataFrame([(n, None if n % 4 < 2 else "t", [], v.tolist()) for n, v in enumerate(m)], ENTITIES)
    none, mentions = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, n long, first long")
    want = sorted((-round(float(m[n] @ m[n + 1]), 9), n, n + 1) for n in range(0, 1400, 2))
    told = lambda limit: [(-r["cosine"], r["keep"], r["absorb"]) for r in dup.merge_proposals(table, none, mentions, limit=limit).orderBy("rank").collect()]
    assert told(1000) == want
    for name, value in (("EXACT_PAIRS", 0), ("BUCKET_ROWS", 60), ("BLOCK_ROWS", 50)):
        monkeypatch.setattr(dup, name, value)
    assert told(5) == want[:5]
