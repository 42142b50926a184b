"""Decay, tiering, sessions, clustering, summaries, scopes and deletion.  Write-backs are returned as update frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Defaults
from engram.functions.scalars import cycle_rate
from engram.sources.driver import DAY_US


def decay_turns(turns: DataFrame, now_us: int, cycles: int, creative: Column, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(turn_id, decay, is_archived): closed-form decay of turns older than a week that aren't bookmarked, then restore and archive."""
    old = (F.lit(now_us) - F.col("us") > 7 * DAY_US) & ~F.col("is_bookmarked")
    daily = F.when(creative, cfg.decay_creative).when(F.col("accesses") > 0, cfg.decay_accessed).otherwise(cfg.decay_unaccessed)
    aged = F.when(old, F.col("decay") * F.pow(cycle_rate(daily, cfg), F.lit(cycles))).otherwise(F.col("decay"))
    score = F.round(F.when(creative, F.greatest(aged, F.lit(cfg.creative_floor))).otherwise(aged), 6)
    return turns.select("turn_id", score.alias("decay")).withColumn("is_archived", F.col("decay") < cfg.archive_threshold)


def tiers(turns: DataFrame, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(turn_id, tier): hot, archived or cold."""
    return turns.select(
        "turn_id", F.when(F.col("is_archived") & (F.col("decay") < cfg.cold_threshold), "cold").when(F.col("decay") < cfg.archive_threshold, "archived").otherwise("hot").alias("tier")
    )


def sessions(turns: DataFrame, gap_minutes: int) -> DataFrame:
    """Turns with their session number: a gap beyond ``gap_minutes`` begins a new one; a gap of just that continues."""
    order = Window.partitionBy("conversation_id").orderBy("us", "turn_id")
    new = F.coalesce((F.col("us") - F.lag("us").over(order) > gap_minutes * 60_000_000).cast("int"), F.lit(1))
    return turns.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def stickiness(turns: DataFrame, shifts: int = 3) -> DataFrame:
    """(turn_id, run, switch): length of the current run of topic shifts; a switch at three in a row."""
    order = Window.partitionBy("conversation_id").orderBy("us", "turn_id")
    shifted = turns.withColumn("shift", (F.col("topic") != F.lag("topic").over(order)).cast("int"))
    shifted = shifted.withColumn("shift", F.coalesce("shift", F.lit(0)))
    breaks = shifted.withColumn("island", F.sum((F.col("shift") == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("conversation_id", "island").orderBy("us", "turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return breaks.withColumn("run", F.sum("shift").over(inside).cast("int")).select("turn_id", "run", (F.col("run") >= shifts).alias("switch"))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): normalised means of member vectors, summed by dimension with map-side partials."""
    sums = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return mean.select(key, F.transform("m", lambda x: x / size).alias("centroid"))


def recurring(members: DataFrame, first: int = 10, least: int = 2, top: int = 15) -> DataFrame:
    """(cluster_id, entity, n, rank): entities in several of a cluster's first members."""
    order = Window.partitionBy("cluster_id").orderBy("us", "turn_id")
    early = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first)
    counts = early.groupBy("cluster_id", "entity").agg(F.count_distinct("turn_id").alias("n")).where(F.col("n") >= least)
    best = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "entity")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def summary_batches(turns: DataFrame, now_us: int, size: int = 50, least: int = 5, age_days: int = 30) -> DataFrame:
    """(conversation_id, batch, first, last, n): turns ready for a summary, in batches of fifty, none of fewer than five."""
    ready = turns.where(~F.col("is_private") & ~F.col("is_document") & ((F.col("decay") < 0.3) | (F.lit(now_us) - F.col("us") > age_days * DAY_US)))
    order = Window.partitionBy("conversation_id").orderBy("us", "turn_id")
    placed = ready.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    return placed.groupBy("conversation_id", "batch").agg(F.min("turn_id").alias("first"), F.max("turn_id").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)


def summary_gate(messages: DataFrame, window_tokens: int) -> DataFrame:
    """(conv_id, n, tokens, due): conversations whose text outgrows the window."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.length("text") / 4)).alias("tokens")).withColumn("due", F.col("tokens") > window_tokens)


def stale_patterns(patterns: DataFrame, now_us: int, days: int = 180, least: int = 3) -> DataFrame:
    return patterns.withColumn("is_active", ~((F.lit(now_us) - F.col("last_us") > days * DAY_US) & (F.col("reinforced") < least)))


def scoped(turns: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Turns of the stated conversations; none stated (an empty frame) matches nothing, None is no scope."""
    return turns if conversations is None else turns.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi")


def excluded(turns: DataFrame, conversations: DataFrame, clusters: DataFrame) -> DataFrame:
    return turns.join(conversations, "conversation_id", "left_anti").join(clusters, "cluster_id", "left_anti")


def in_clusters_or_unlinked(turns: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Turns linked to a wanted cluster, or to none at all."""
    marks = links.join(wanted.withColumn("hit", F.lit(True)), "cluster_id", "left").groupBy("turn_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    return turns.join(marks, "turn_id", "left").where("hit is null or hit").drop("hit")


def visible(turns: DataFrame, mode: str, t0: int, t1: int, is_scoped: bool, floor: float = 0.2) -> DataFrame:
    """Privacy, window, archive and decay rules of a time scope."""
    private = F.lit(True) if is_scoped else ~F.col("is_private")
    if mode == "current":
        return turns.where(private & ~F.col("is_archived") & (F.col("decay") > floor))
    return turns.where(private & (F.col("us") >= t0) & (F.col("us") < t1))


def document_visibility(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, shared, status): a document enabled by two conversations is shared for good."""
    counts = links.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("enabled"), F.col("conv_id"))).alias("n"), F.bool_or("enabled").alias("any"))
    joined = docs.join(counts, "doc_id", "left")
    shared = F.coalesce(F.col("n"), F.lit(0)) >= 2
    return joined.select("doc_id", shared.alias("shared"), F.when(F.col("n").isNull(), "unlinked").when(F.col("any"), "enabled").otherwise("hidden").alias("status"))


def assign_clusters(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(group, id, cluster): sequential assignment to the best centroid, which moves with each member; a grouped map."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        out = []
        sums, sizes, held = np.zeros((16, len(frame["vector"].iloc[0]))), np.zeros(16), 0
        for v in frame["vector"]:
            v = np.asarray(v, float)
            # all centroids at once; both arrays double when they are full
            scale = sizes[:held] * np.linalg.norm(v)
            near = sums[:held] @ v / np.where(scale > 0, scale, 1)
            best = int(np.argmax(near)) if held else -1
            if best < 0 or near[best] < threshold:
                if held == len(sums):
                    sums, sizes = np.concatenate((sums, np.zeros_like(sums))), np.concatenate((sizes, np.zeros_like(sizes)))
                best, held = held, held + 1
            sums[best] += v
            sizes[best] = np.linalg.norm(sums[best])
            out.append(best)
        return pd.DataFrame({"group": key[0], "id": frame["id"].to_numpy(), "cluster": out})

    return rows.groupBy("group").applyInPandas(run, "group long, id long, cluster int")
