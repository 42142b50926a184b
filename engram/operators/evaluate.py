"""Evaluation of runs and labels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def impute(scores: DataFrame) -> DataFrame:
    """(probe, condition, score, kind): observed, 1 for a failed answer, the paired condition, the probe's rounded mean, or 3."""
    probe = Window.partitionBy("probe")
    pair = F.first("score", ignorenulls=True).over(Window.partitionBy("probe", "pair").orderBy("condition").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean = F.bround(F.avg("score").over(probe), 0)
    rungs = (("observed", F.col("score")), ("failed", F.when(F.col("failed"), 1.0)), ("paired", pair), ("probe", mean), ("default", F.lit(3.0)))
    kind = F.coalesce(*[F.when(value.isNotNull(), F.lit(name)) for name, value in rungs])
    return scores.select("probe", "condition", F.coalesce(*[v for _, v in rungs]).cast("double").alias("value"), kind.alias("kind"))


def summarise(rows: DataFrame) -> DataFrame:
    """(condition, n, mean, sd, tokens, tur, spf, good, ok, poor): one aggregation."""
    share = lambda test: F.round(100 * F.count_if(test) / F.count("*"), 4)
    return rows.groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("sd"), F.round(F.avg("tokens"), 6).alias("tokens"),
        F.round(F.avg(F.col("score") / (F.col("tokens") / 1000)), 6).alias("tur"), F.round(F.avg(F.col("score") / F.col("fragments")), 6).alias("spf"),
        share(F.col("score") >= 4).alias("good"), share((F.col("score") >= 3) & (F.col("score") < 4)).alias("ok"), share(F.col("score") < 3).alias("poor"),
    )


def wins(rankings: DataFrame, present: list[str]) -> DataFrame:
    """(condition, wins, appearances, rate) of rankings (probe, ranking): the first of the conditions that are present."""
    known = F.array(*map(F.lit, present))
    kept = rankings.select(F.filter("ranking", lambda c: F.array_contains(known, c)).alias("r")).where(F.size("r") > 0)
    seen = kept.select(F.posexplode("r").alias("place", "condition"))
    return seen.groupBy("condition").agg(
        F.count_if(F.col("place") == 0).alias("wins"), F.count("*").alias("appearances"), F.round(F.count_if(F.col("place") == 0) / F.count("*"), 6).alias("rate")
    )


def binned(rows: DataFrame, position: Column, width: int = 50) -> DataFrame:
    return rows.groupBy((F.floor(position / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def leg_shares(rows: DataFrame) -> DataFrame:
    """(leg, mean, share): mean count of fragments where the leg occurs, and its share of all means."""
    means = rows.groupBy("probe", "leg").agg(F.count("*").alias("n")).groupBy("leg").agg(F.avg("n").alias("mean"))
    total = F.sum("mean").over(Window.partitionBy())
    return means.select("leg", F.round("mean", 6).alias("mean"), F.round(F.col("mean") / total, 6).alias("share"))


def f1(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, support) of (label, target, predicted)."""
    hit = F.count_if(F.col("target") & F.col("predicted"))
    counts = rows.groupBy("label").agg(hit.alias("tp"), F.count_if(~F.col("target") & F.col("predicted")).alias("fp"), F.count_if(F.col("target") & ~F.col("predicted")).alias("fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label", "tp", "fp", "fn", F.round(safe(tp, tp + fp), 6).alias("precision"), F.round(safe(tp, tp + fn), 6).alias("recall"),
        F.round(safe(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), (tp + fn).alias("support"),
    )


def sweep(rows: DataFrame, grid: list[float]) -> DataFrame:
    """(label, threshold, f1): each label's best threshold of (label, target, chance); the lowest of equals."""
    at = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    scored = at.withColumn("predicted", F.col("chance") > F.col("threshold")).groupBy("label", "threshold").agg(
        F.count_if(F.col("target") & F.col("predicted")).alias("tp"), F.count_if(F.col("target") != F.col("predicted")).alias("wrong")
    )
    value = F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0)), 6)
    best = scored.withColumn("f1", value).groupBy("label").agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("x"))
    return best.select("label", "x.threshold", "x.f1")


def floors(counts: DataFrame, drop: int = 150, thin: int = 300) -> DataFrame:
    return counts.withColumn("verdict", F.when(F.col("n") < drop, "DROP").when(F.col("n") < thin, "thin").otherwise("ok"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, topic, exact): do two labelers' sets overlap, and are they equal?"""
    both = a.select(key, F.array_sort(F.array_distinct("labels")).alias("x")).join(b.select(key, F.array_sort(F.array_distinct("labels")).alias("y")), key)
    return both.select(key, F.arrays_overlap("x", "y").alias("overlap"), (F.col("x") == F.col("y")).alias("exact"))


def merge_labels(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """(key, labels, how): what two labelers share; else what a third settles by majority; else a human."""
    rows = a.select(key, F.col("labels").alias("a")).join(b.select(key, F.col("labels").alias("b")), key).join(c.select(key, F.col("labels").alias("c")), key, "left")
    both = F.array_intersect("a", "b")
    third = F.array_union(F.array_intersect("a", F.coalesce("c", F.array())), F.array_intersect("b", F.coalesce("c", F.array())))
    return rows.select(
        key, F.array_join(F.array_sort(F.when(F.size(both) > 0, both).when(F.size(third) > 0, third).otherwise(F.array().cast("array<string>"))), ",").alias("labels"),
        F.when(F.size(both) > 0, "agreed").when(F.size(third) > 0, "majority").otherwise("human").alias("how"),
    )


def set_scores(rows: DataFrame) -> DataFrame:
    """tp, fp, fn, exact and micro-F1 over label sets (gold, predicted)."""
    hit = F.size(F.array_intersect("gold", "predicted"))
    sums = rows.agg(
        F.sum(hit).alias("tp"), F.sum(F.size("predicted") - hit).alias("fp"), F.sum(F.size("gold") - hit).alias("fn"),
        F.count_if(F.array_sort("gold") == F.array_sort("predicted")).alias("exact"),
    )
    return sums.withColumn("micro_f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def class_weights(rows: DataFrame, cap: float = 10.0) -> DataFrame:
    """(label, weight): negatives over positives, capped; 1 without positives."""
    n = rows.groupBy("label").agg(F.count_if("target").alias("pos"), F.count_if(~F.col("target")).alias("neg"))
    return n.select("label", F.round(F.when(F.col("pos") == 0, 1.0).otherwise(F.least(F.lit(cap), F.col("neg") / F.col("pos"))), 6).alias("weight"))


def steps(rows: DataFrame) -> DataFrame:
    """(condition, mean, delta, total): changes along an ordered chain of conditions, and from its start."""
    order = Window.orderBy("nth")
    means = rows.groupBy("nth", "condition").agg(F.avg("score").alias("m"))
    return means.select(
        "condition", F.round("m", 6).alias("mean"), F.round(F.col("m") - F.lag("m").over(order), 6).alias("delta"), F.round(F.col("m") - F.first("m").over(order), 6).alias("total")
    )


def as_of(probes: DataFrame, truths: DataFrame) -> DataFrame:
    """(probe, turn, answer): the latest truth at or before a probe's turn; null if none.

    Probes and truths are merged into one ordered stream a key, so the join is a
    running maximum: no pairs of probes and truths are made.
    """
    t = truths.select("key", "turn", F.struct("turn", "truth_id", "answer").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("probe"))
    p = probes.select("key", "turn", F.lit(None).cast(t.schema["t"].dataType).alias("t"), F.lit(1).alias("kind"), F.col("probe").cast("long").alias("probe"))
    order = Window.partitionBy("key").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return t.unionByName(p).withColumn("last", F.max("t").over(order)).where("kind = 1").select("probe", "turn", F.col("last.answer").alias("answer"))


def bootstrap(rows: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(condition, mean, low, high): percentile intervals of the mean; one condition's scores as counts by value.

    Scores are few values, so a resample is a multinomial draw on their counts: the
    group sent to a task has a row a value, not a row a score.
    """
    counts = rows.groupBy("condition", "score").agg(F.count("*").alias("n"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("score")
        n, values = frame["n"].to_numpy(float), frame["score"].to_numpy(float)
        rng = np.random.default_rng([seed, zlib.crc32(str(key[0]).encode())])
        draws = rng.multinomial(int(n.sum()), n / n.sum(), resamples) @ values / n.sum()
        low, high = np.percentile(draws, [2.5, 97.5])
        return pd.DataFrame({"condition": [key[0]], "mean": [float(n @ values / n.sum())], "low": [low], "high": [high]})

    return counts.groupBy("condition").applyInPandas(run, "condition string, mean double, low double, high double")
