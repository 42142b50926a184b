"""The retention matrix against its SQL on hostile clicks: clients over many partitions, ties, repeats, nulls."""

import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
from compare import same

from engram.llm import retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def both(spark, clicks, clients):
    con = duckdb.connect()
    con.execute("CREATE TABLE clicks (click_id BIGINT, ts TIMESTAMP, arrived_at TIMESTAMP, client_id BIGINT, kind VARCHAR, value DOUBLE, props VARCHAR)")
    con.execute("CREATE TABLE clients (client_id BIGINT, city VARCHAR)")
    con.executemany("INSERT INTO clicks VALUES (?, ?, ?, ?, ?, ?, ?)", clicks)
    if clients:
        con.executemany("INSERT INTO clients VALUES (?, ?)", clients)
    got = retention.retention(spark.createDataFrame(clicks, CLICKS).repartition(6), spark.createDataFrame(clients, "client_id long, city string"))
    same(got, con, retention.ORACLE_SQL)
    return got


def hostile(n, seed, clients, times):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        ts = None if r.random() < 0.03 else datetime(2024, 2, 20) + timedelta(microseconds=r.choice(times))
        arrived = None if r.random() < 0.05 or ts is None else ts + timedelta(seconds=r.choice((0, 1, 864_000, 1_000_000)))
        rows.append((None if r.random() < 0.03 else k, ts, arrived, r.choice(clients), r.choice(("view", "click", "purchase", None)), r.choice((None, 0.005, 1.115, 99.995, -3.333)), r.choice(("{}", None))))
    rows += r.sample(rows, n // 10)
    r.shuffle(rows)
    return rows


def test_a_client_over_all_partitions_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(retention, "parallelism", lambda _: 23)
    times = [n * 3_600_000_000 // 7 for n in range(3000)]
    clicks = hostile(1500, 1, [1] * 10 + [2, 3, 4, None], times)
    assert both(spark, clicks, [(1, "b"), (1, "a"), (2, None), (7, "x")]).where("users > 0").count() > 20


def test_ties_within_a_microsecond_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(retention, "parallelism", lambda _: 40)
    clicks = hostile(900, 2, [1, 2, 3], [0, 1, 259_200_000_000, 259_199_999_999, 518_400_000_001])
    both(spark, clicks, [(n, "same") for n in range(3)])


def test_one_row_and_odd_values(spark):
    at = datetime(1969, 12, 30, 5)
    clicks = [(5, at, at, 9, "purchase", float("nan"), None), (6, at, at, 9, "view", float("inf"), None), (8, at + timedelta(days=4), None, 9, "view", 1.0, "x")]
    got = retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame([], "client_id long, city string"))
    assert sorted((r["state"], r["segment"], r["cohort"], r["period"], r["users"], r["cents"]) for r in got.collect()) == [(0, "", -1, 0, 1, 0), (1, "", -1, 0, 1, 0), (1, "", -1, 1, 1, 100)]


def test_batches_of_any_size_make_the_same_runs():
    import numpy as np

    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"client": rng.integers(0, 5, 400), "us": rng.integers(0, 40, 400) * 86_400_000_000, "rank": rng.integers(0, 3, 400)})
    frame["early"], frame["cents"] = (frame["rank"] == 0) | (rng.random(400) < 0.5), rng.integers(0, 9, 400)
    frame = frame.sort_values(["client", "us", "rank"])
    columns = [frame[c].to_numpy() for c in ("client", "us", "rank", "early", "cents")]

    def runs(size, state):
        scan, out = retention.Scan(state, None, retention.NEVER, 3 * retention.DAY_US, 3), []
        for at in range(0, 400, size):
            out.append(scan.take(*[c[at : at + size] for c in columns]))
        return np.concatenate([*out, scan.open], axis=1).tolist()

    for state in (0, 1):
        whole = runs(400, state)
        assert len(whole[0]) > 20 and all(runs(size, state) == whole for size in (1, 7, 133))
