"""Audits of runs and labels: failures, averages, tuning, firing, promotion, sampling points, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gating_failures(scores: DataFrame, floor: float = 3.0) -> DataFrame:
    """Probes that were answered without memory and badly."""
    return scores.where((F.col("label") == "Zero_Shot") & (F.col("score") < floor))


def category_averages(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, condition, mean, n): means over the conditions that a category lists."""
    return scores.join(categories, "condition").groupBy("category", "condition").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def tuned(rows: DataFrame, thresholds: list[float], least_recall: float) -> DataFrame:
    """(threshold, recall, specificity): the best specificity among thresholds whose recall holds; of equal ones the lowest.

    ``rows`` has chance and target; one pass counts for all thresholds.
    """
    aggs = [F.count_if(F.col("target")).alias("yes"), F.count_if(~F.col("target")).alias("no")]
    for n, t in enumerate(thresholds):
        aggs += [F.count_if(F.col("target") & (F.col("chance") >= t)).alias(f"tp{n}"), F.count_if(~F.col("target") & (F.col("chance") < t)).alias(f"tn{n}")]
    lines = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.round(F.try_divide(f"tp{n}", "yes"), 6).alias("recall"), F.round(F.try_divide(f"tn{n}", "no"), 6).alias("specificity")) for n, t in enumerate(thresholds)
    ])
    every = rows.agg(*aggs).select(F.inline(lines))
    return every.where(F.col("recall") >= least_recall).orderBy(F.desc("specificity"), "threshold").limit(1)


def hard_negatives(rows: DataFrame, referential: Column) -> DataFrame:
    """(id, text, context, needs): context rows that need no memory though they sound so, each with a twin without its context."""
    hard = rows.where(~F.col("needs") & F.col("context").isNotNull() & referential)
    return hard.select("id", "text", "context", "needs").unionByName(hard.select("id", "text", F.lit(None).cast("string").alias("context"), "needs"))


def firing(rows: DataFrame, label: str) -> DataFrame:
    """(companion, n, share): the labels that stand beside a label, by how often; ``rows`` has labels."""
    fired = rows.where(F.array_contains("labels", label))
    pairs = fired.select(F.explode(F.array_distinct(F.array_remove("labels", label))).alias("companion"))
    total = fired.agg(F.count("*").alias("total"))
    return pairs.groupBy("companion").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("companion", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # total is one row


def promotion(models: DataFrame, least_labels: int = 20) -> DataFrame:
    """(model, promote, why): a fine-tuned model replaces the old one with enough labels and a held-out loss no worse."""
    enough = F.col("n_labels") >= least_labels
    better = F.col("loss") <= F.col("old_loss")
    why = F.when(~enough, "too few labels").when(F.coalesce(~better, F.lit(True)), "loss is worse").otherwise("promoted")
    return models.select("model", (enough & F.coalesce(better, F.lit(False))).alias("promote"), why.alias("why"))


def checkpoints(conversations: DataFrame, every: int = 40, gap: int = 5, jitter: float = 0.2) -> DataFrame:
    """(conversation_id, at): evenly spaced points of a conversation of ``total`` turns, shifted by a hash, at least ``gap`` apart, the last at its end.

    The number grows with the length: one for each ``every`` turns, one at least.
    """
    n = F.greatest(F.lit(1), F.floor(F.col("total") / every)).cast("int")
    step = F.col("total") / n
    points = conversations.select("conversation_id", "total", n.alias("n"), step.alias("step"), F.explode(F.sequence(F.lit(1), n)).alias("nth"))
    unit = F.conv(F.substr(F.md5(F.concat_ws(":", F.col("conversation_id").cast("string"), F.col("nth").cast("string"))), F.lit(1), F.lit(6)), 16, 10).cast("double") / 0xFFFFFF
    raw = F.round(F.col("step") * F.col("nth") + (unit * 2 - 1) * jitter * F.col("step")).cast("long")
    at = F.when(F.col("nth") == F.col("n"), F.col("total")).otherwise(F.least(F.greatest(raw, F.lit(1)), F.col("total") - gap))
    order = Window.partitionBy("conversation_id").orderBy("nth")
    placed = points.withColumn("at", at)
    return placed.withColumn("next", F.lead("at").over(order)).where(F.col("next").isNull() | (F.col("next") - F.col("at") >= gap)).where("at >= 1").select("conversation_id", "at")


def paired_bootstrap(pairs: DataFrame, rounds: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(delta, delta_low, delta_high, win, win_low, win_high) of paired scores (probe, a, b): b over a.

    Each round draws every probe 0 to 3 times by a hash of round and probe (a Poisson bootstrap), so no
    round needs all probes in one place, and reruns agree.
    """
    digest = F.md5(F.concat_ws(":", F.col("round").cast("string"), F.col("probe").cast("string")))
    unit = F.conv(F.substr(digest, F.lit(1), F.lit(6)), 16, 10).cast("double") / 0x1000000
    times = F.when(unit < 0.36787944, 0).when(unit < 0.73575888, 1).when(unit < 0.9196986, 2).otherwise(3)
    drawn = pairs.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("times", times)
    won = F.when(F.col("b") > F.col("a"), 1.0).when(F.col("b") == F.col("a"), 0.5).otherwise(0.0)
    each = drawn.groupBy("round").agg(
        (F.sum(F.col("times") * (F.col("b") - F.col("a"))) / F.sum("times")).alias("delta"), (F.sum(F.col("times") * won) / F.sum("times")).alias("win")
    )
    bounds = [F.round(F.percentile(c, q), 6).alias(f"{c}_{name}") for c in ("delta", "win") for name, q in (("low", low), ("high", high))]
    means = pairs.agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("delta"), F.round(F.avg(won), 6).alias("win"))
    return means.join(F.broadcast(each.agg(*bounds)))  # one row each


def quartile_chunks(turns: DataFrame) -> DataFrame:
    """(conversation_id, quartile, tokens, n): a conversation's turns in four runs of equal number, by time."""
    order = Window.partitionBy("conversation_id").orderBy("us", "turn_id")
    return turns.withColumn("quartile", F.ntile(4).over(order)).groupBy("conversation_id", "quartile").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def savings(rows: DataFrame) -> DataFrame:
    """(condition, tokens, fragments, token_savings, fragment_savings): means, and their shares saved against the base condition."""
    base = rows.where("is_base").agg(F.avg("tokens").alias("bt"), F.avg("fragments").alias("bf"))
    means = rows.groupBy("condition").agg(F.avg("tokens").alias("tokens"), F.avg("fragments").alias("fragments"))
    saved = lambda now, then: F.round(1 - F.try_divide(now, then), 6)
    out = means.join(F.broadcast(base))  # base is one row
    return out.select("condition", F.round("tokens", 6).alias("tokens"), F.round("fragments", 6).alias("fragments"), saved("tokens", "bt").alias("token_savings"), saved("fragments", "bf").alias("fragment_savings"))


def weak_labels(text: Column, cues: dict[str, tuple[str, ...]]) -> Column:
    """Sorted labels whose cues a text holds: weak supervision by stated phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)), F.lit(label)) for label, phrases in sorted(cues.items())]
    return F.array_compact(F.array(*hits))
