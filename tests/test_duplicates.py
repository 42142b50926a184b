"""Duplicate entities: recall of the buckets against all pairs, exact counts and classes, decided pairs, odd vectors."""

import numpy as np

from engram.operators import duplicates as dup


def planted(seed=3, groups=60, copies=4, width=48):
    """Groups of vectors at cosines of 0.9 to 0.97 to their centre, among unrelated ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(width)
        centre /= np.linalg.norm(centre)
        for _ in range(copies):
            noise = rng.standard_normal(width)
            noise -= centre * (noise @ centre)
            cosine = rng.uniform(0.955, 0.99)
            rows.append(centre * cosine + noise / np.linalg.norm(noise) * np.sqrt(1 - cosine**2))
    rows += list(rng.standard_normal((1500, width)))
    return np.array(rows)


def test_recall_against_all_pairs(spark, monkeypatch):
    m = planted()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9) >= 0.9
    np.fill_diagonal(near, False)
    monkeypatch.setattr(dup, "BLOCK_ROWS", 40)
    table = spark.createDataFrame([(n, 1, ["x"] if n < 0 else [], v.tolist()) for n, v in enumerate(m)], "id long, group int, names array<string>, vector array<double>").repartition(6)
    got = {r["id"]: r["links"] for r in dup.duplicate_classes(table).collect()}
    found, want = sum(got.values()), int(near.sum())
    assert all(got[n] <= near[n].sum() for n in got) and want > 300 and found >= 0.98 * want
    bits, bands = dup.banding(10**9)
    assert bits == 24 and bands < 1200 and dup.banding(1740)[1] < 60


def test_classes_counts_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(dup, "BLOCK_ROWS", 7)
    rows = [(n, "t", [], [1.0, 2.0, 3.0]) for n in range(50)]  # one vector many times
    rows += [(100, "t", [], [2.0, 4.0, 6.001]), (101, "other", [], [1.0, 2.0, 3.0]), (102, None, [], [1.0, 2.0, 3.0]), (103, None, [], [1.0, 2.0, 3.0])]
    rows += [(200, "t", ["Ann "], None), (201, "u", ["ANN", "Bo"], [0.0, 0.0, 0.0]), (202, "v", ["bo"], [float("nan")] * 3), (203, "t", [""], [1.0]), (204, "t", None, [])]
    got = {r["id"]: (r["links"], r["component"]) for r in dup.duplicate_classes(spark.createDataFrame(rows, "id long, group string, names array<string>, vector array<double>")).collect()}
    assert got[0] == got[49] == got[100] == (50, 0) and got[101] == (0, 101) and got[102] == got[103] == (1, 102)
    assert got[200] == got[201] == got[202] == (0, 200) and got[203] == (0, 203) and got[204] == (0, 204) and len(got) == len(rows)


def test_proposals_leave_out_what_was_decided(spark):
    rows = [(n, "t", [f"n{n}"], [1.0, 0.01 * n]) for n in range(6)] + [(10, "t", ["Same"], [0.0, 1.0]), (11, "z", ["same"], None)]
    table = spark.createDataFrame(rows, "id long, group string, names array<string>, vector array<double>")
    decided = spark.createDataFrame([(1, 0), (2, 3)], "a long, b long")
    mentions = spark.createDataFrame([(11, 5, 9), (5, 2, 1), (4, 2, 0)], "id long, n long, first long")
    got = [tuple(r) for r in dup.merge_proposals(table, decided, mentions, limit=40).orderBy("rank").select("keep", "absorb").collect()]
    pairs = {tuple(sorted(p)) for p in got}
    assert got[0] == (11, 10) and len(got) == 1 + 15 - 2 and not pairs & {(0, 1), (2, 3)} and (4, 5) in got
    assert [tuple(r) for r in dup.merge_proposals(table, decided, mentions, limit=3).orderBy("rank").select("keep", "absorb").collect()] == got[:3]


def test_ids_that_several_groups_have_are_told_apart(spark):
    from engram.operators.similar import linked_groups

    rows = [(g, n, [1.0, 0.0] if (n < 3) == (g == 1) else [0.0, 1.0 + n]) for g in (1, 2) for n in range(6)]
    got = {(r["group"], r["id"]): (r["links"], r["component"]) for r in linked_groups(spark.createDataFrame(rows, "group long, id long, vector array<double>"), 0.9, True, 2).collect()}
    assert all(got[g, n] == (2, 0 if n < 3 else 3) for g in (1, 2) for n in range(6))
