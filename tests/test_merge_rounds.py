"""Merging clusters: after the first round only what has changed asks."""

import numpy as np
from test_clusters import plain_merge

from engram.operators import clusters as cl


def test_later_rounds_ask_with_few(spark, monkeypatch):
    """A chain that takes several rounds beside many that stay: after the first round only what has changed meets the others."""
    rng = np.random.default_rng(7)
    chain = [[float(np.cos(t)), float(np.sin(t))] + [0.0] * 10 for t in (0.0, 0.4, 0.8, 1.2, 1.6, 2.0)]
    rows = [(0, n, n, 1, v, ["x"] if n % 2 else ["x", "y"]) for n, v in enumerate(chain)]
    rows += [(0, 10 + n, n, 1, rng.standard_normal(12).tolist(), []) for n in range(120)]
    asked, real = [], cl._absorbers

    def told(live, *rest):
        asked.append((live.where("asks").count(), live.count()))
        return real(live, *rest)

    monkeypatch.setattr(cl, "_absorbers", told)
    table = spark.createDataFrame(rows, "group int, id long, age int, n int, vector array<double>, cast array<string>")
    got = {r["id"]: r["into"] for r in cl.merge_clusters(table, block_rows=30).collect()}
    assert got == plain_merge(rows) and len(asked) > 2
    assert asked[0] == (126, 126) and all(a <= 6 < n for a, n in asked[1:])
