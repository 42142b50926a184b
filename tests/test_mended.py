"""Samples, searches and bounds on inputs that once broke them."""

import numpy as np
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import ingest


def test_stride_sample_with_other_columns(spark):
    n = 100_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("key"), F.concat(F.lit("row "), (F.col("id") * 7919) % n).alias("other"), F.rand(3).alias("noise"))
    got = sorted(r["key"] for r in ingest.stride_sample(rows, "key").select("key", "other").collect())
    step = (n - 25) // 25
    assert got == [*range(25), *[25 + step * k for k in range(25)]]


def test_vectors_of_any_length_and_broken_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.normal(size=3 if n % 4 else 5)]) for n in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0]), (62, [float("nan")] * 3), (63, [])]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = table.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in vectors.block_topk(table, asked, 4, "id", "v").collect()}
    want = {}
    good = [(n, np.array(v)) for n, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % 3 == 0:
            best = sorted((-round(float(a @ b), 6), n) for n, b in good if len(a) == len(b))[:4]
            want |= {(q, k + 1): (n, -s) for k, (s, n) in enumerate(best)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_recent_window_is_the_sitting_and_a_bridge(spark):
    from engram.operators import assemble

    minute = 60_000_000
    times = {1: [0, 10, 20, 100, 110, 125], 2: [0, 40, 80], 3: [5]}
    rows = [(c, 10 * c + n, t * minute, 100, None, None) for c, own in times.items() for n, t in enumerate(own)]
    rows += [(4, n, n * minute, 100 if n < 7 else 9000, 300 if n == 7 else None, 50) for n in range(9)]
    turns = spark.createDataFrame(rows, "conversation_id int, turn_id int, us long, tokens int, summary_tokens int, abstract_tokens int")
    got = {}
    for r in assemble.recent_window(turns, 900).orderBy("nth").collect():
        got.setdefault(r["conversation_id"], []).append((r["turn_id"], r["form"], r["cost"]))
    assert [x[0] for x in got[1]] == [15, 14, 13, 12] and [x[0] for x in got[2]] == [22, 21] and [x[0] for x in got[3]] == [30]
    assert got[4][:2] == [(8, "abstract", 50), (7, "summary", 300)] and [x[0] for x in got[4]] == [8, 7, 6, 5, 4, 3, 2]
    assert [x[0] for r in [assemble.recent_window(turns, 900, most=2, bridge=0).where("conversation_id = 1").orderBy("nth").collect()] for x in [(y["turn_id"],) for y in r]] == [15, 14]
