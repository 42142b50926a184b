"""Record-level rules: gates, matching, normalisation, write-backs and status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.ingest import sums_before

from engram.config import DEFAULTS, Defaults
from engram.functions import text as tx
from engram.sources.driver import DAY_US


def usable_prompt(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))).between(12, 8000)


def failed_answer(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | F.startswith(F.upper(t), F.lit("ERROR")) | (F.length(t) < 5)


def triggers(pattern_topics: Column, pattern_intents: Column, topics: Column, intents: Column) -> Column:
    """A pattern's topics and intents are each empty or share one with the query."""
    fits = lambda a, b: (F.size(a) == 0) | F.arrays_overlap(a, b)
    return fits(pattern_topics, topics) & fits(pattern_intents, intents)


def graph_scope(entities: DataFrame, conversations: DataFrame) -> DataFrame:
    """Entities with evidence from the batches of the stated conversations: two semi-joins."""
    batches = entities.join(conversations, "conversation_id", "left_semi").select("batch").where("batch is not null").distinct()
    return entities.join(batches, "batch", "left_semi").select("entity").distinct()


def match_names(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, entity_id): equal to a canonical name before an alias, then the smaller id."""
    names = entities.select("entity_id", F.explode(F.array(F.struct(F.lower("name").alias("key"), F.lit(0).alias("rank")))).alias("x")).unionByName(
        entities.select("entity_id", F.explode(F.transform("aliases", lambda a: F.struct(F.lower(a).alias("key"), F.lit(1).alias("rank")))).alias("x"))
    )
    hits = mentions.withColumn("key", F.lower(F.trim("mention"))).join(names.select("entity_id", "x.key", "x.rank"), "key")
    return hits.groupBy("mention").agg(F.min(F.struct("rank", "entity_id")).alias("b")).select("mention", F.col("b.entity_id").alias("entity_id"))


def normalise_term(term: Column) -> Column:
    """Lower case, leading articles and outer punctuation off, single spaces."""
    bare = F.regexp_replace(F.lower(F.trim(term)), r"^(?:the|a|an)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[^a-z0-9]+|[^a-z0-9]+$", ""), r"\s+", " "))


def grounded(term: Column, text: Column) -> Column:
    """All words of a term occur in a text."""
    return F.size(F.array_except(tx.words(normalise_term(term)), tx.words(F.lower(text)))) == 0


def normalise_relation(surface: Column, vocabulary: list[str]) -> Column:
    """A relation's surface form as a word of the vocabulary: as it is, with underscores, without an ending; null if none fits."""
    low = F.regexp_replace(F.lower(F.trim(surface)), r"[\s-]+", "_")
    forms = F.array(low, F.regexp_replace(low, "(?:s|ed|ing)$", ""), F.regexp_replace(low, "^(?:is|was|are)_", ""), F.concat(low, F.lit("s")))
    known = F.array(*map(F.lit, vocabulary))
    return F.try_element_at(F.filter(forms, lambda f: F.array_contains(known, f)), F.lit(1))


def strengthen(turns: DataFrame, reads: DataFrame, cfg: Defaults = DEFAULTS, amount: float = 0.15) -> DataFrame:
    """(turn_id, decay, accesses) of turns that were read: repeated reads add up under the cap."""
    n = reads.groupBy("turn_id").agg(F.count("*").alias("n"))
    return turns.join(n, "turn_id").select("turn_id", F.round(F.least(F.lit(1.0), F.col("decay") + amount * F.col("n")), 6).alias("decay"), (F.col("accesses") + F.col("n")).cast("long").alias("accesses"))


def reinforce(edges: DataFrame, used: DataFrame) -> DataFrame:
    """(edge_id, strength, promoted): one increment an edge however often it was used; promotion at strength 2 and confidence .5."""
    hit = edges.join(used.select("edge_id").distinct(), "edge_id", "left_semi")
    strength = F.least(F.lit(10.0), F.col("strength") + 0.15)
    return hit.select("edge_id", F.round(strength, 6).alias("strength"), ((strength >= 2) & (F.coalesce("confidence", F.lit(1.0)) >= 0.5)).alias("promoted"))


def resurrect(hot: DataFrame, cold: DataFrame, hits: DataFrame, score: float = 0.12) -> DataFrame:
    """(turn_id, decay, store) after cold hits with a conversation came back; the others stay citations."""
    back = cold.join(hits.select("turn_id").distinct(), "turn_id", "left_semi").where("conversation_id is not null")
    moved = back.select("turn_id", F.lit(score).alias("decay"), F.lit("hot").alias("store"))
    rest = cold.join(back.select("turn_id"), "turn_id", "left_anti").select("turn_id", F.col("decay").cast("double").alias("decay"), F.lit("cold").alias("store"))
    return hot.select("turn_id", F.col("decay").cast("double").alias("decay"), F.lit("hot").alias("store")).unionByName(moved).unionByName(rest)


def newest(turns: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """(conversation_id, turn_id, rank): the newest turns of each conversation."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("us"), F.desc("turn_id"))
    rows = turns if keep is None else turns.where(keep)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("conversation_id", "turn_id", "rank")


def months_note(turns: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, days): for windows without a turn, the days of the nearest turns of the conversation."""
    empty = asked.join(turns, (turns["conversation_id"] == asked["conv"]) & (turns["us"] >= asked["t0"]) & (turns["us"] < asked["t1"]), "left_anti")
    near = empty.join(turns, turns["conversation_id"] == empty["conv"]).withColumn("gap", F.least(F.abs(F.col("us") - F.col("t0")), F.abs(F.col("us") - F.col("t1"))))
    order = Window.partitionBy("query_id").orderBy("gap", "turn_id")
    top = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    days = F.array_sort(F.collect_set(F.floor(F.col("us") / DAY_US).cast("long")))
    return top.groupBy("query_id").agg(F.array_join(F.transform(days, lambda d: d.cast("string")), ",").alias("days"))


def latest_per(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def infer_types(votes: DataFrame) -> DataFrame:
    """(entity, kind): the kind with most votes, the first by name of equals."""
    n = votes.groupBy("entity", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("entity").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))


def run_status(runs: DataFrame, now_us: int, stale_seconds: float = 600.0) -> DataFrame:
    """(run_id, status): running without a heartbeat for ten minutes is aborted."""
    stale = (F.col("status") == "running") & (F.lit(now_us) - F.col("heartbeat_us") > int(stale_seconds * 1_000_000))
    return runs.select("run_id", F.when(stale, "aborted").otherwise(F.col("status")).alias("status"))


def keyword_density(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords a text holds, capped at 1."""
    low = F.lower(text)
    return F.round(F.least(F.lit(1.0), sum((F.when(F.contains(low, F.lit(k)), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))), 6)


def stitch(rows: DataFrame) -> DataFrame:
    """(conv, turn, position): whole conversations one after the other, by creation; positions are running sums, not a global sort of turns."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.min("us").alias("created"))
    local = F.row_number().over(Window.partitionBy("conv").orderBy("us", "turn"))
    return rows.withColumn("local", local).join(sums_before(sizes, ["created", "conv"], "n").select("conv", "before"), "conv").select("conv", "turn", (F.col("before") + F.col("local")).alias("position"))


def decide_duplicates(pairs: DataFrame) -> DataFrame:
    """(a, b, verdict): duplicate at .95 with the same type, supersede at .85 with shared files, else queue."""
    verdict = F.when((F.col("score") >= 0.95) & F.col("same_type"), "duplicate").when((F.col("score") >= 0.85) & F.col("shared_files"), "supersede").otherwise("queue")
    return pairs.select("a", "b", verdict.alias("verdict"))
