"""The whole way of a prompt: legs under its scope, fusion with its own weights, bonuses, caps, forms, coverage and budget.

A find is (query_id, leg, ref, rank, key, text, degrade, abstract, conversation, origin, us): ``ref`` tells kind and id in one number,
``key`` is the hash of the text, ``origin`` the turn behind it (null: none), ``degrade`` and ``abstract`` what the text may shrink to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Defaults
from engram.functions import text as tx
from engram.functions import vectors
from engram.lineage import cut
from engram.operators import assemble as asm
from engram.operators import legs, lexical, select
from engram.operators import retrieve as rt

KINDS = ("turn", "chunk", "codex", "timeline", "pattern", "summary")
#: Order of the legs where several found a text; the first lends it its id.
ORDER = ("bm25", "vector", "codex", "procedural", "batch_summary", "cold", "timeline", "fallback")
FIND = ("query_id", "leg", "ref", "rank", "key", "text", "degrade", "abstract", "conversation", "origin", "us")


def ref(kind: str, id_: Column) -> Column:
    return id_.cast("long") * 8 + KINDS.index(kind)


def lexical_leg(index: lexical.Index, turns: DataFrame, queries: DataFrame, now_us: int, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, score, rank): the best turns by BM25 of a query's terms (array) among those it may see."""
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    return lexical.search(index, terms, cfg.lexical_limit, scope=(turns, legs.scopes(queries, now_us, cfg)), floor=cfg.visible_decay).select("query_id", F.col("doc_id").alias("id"), "score", "rank")


def summary_leg(summaries: DataFrame, queries: DataFrame, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, score, rank): summaries (id, vector, conversation) nearest to queries about now: three of the query's own conversation, then two of others."""
    asked = queries.where("mode = 'current'").select("query_id", "vector", F.col("own").alias("conversation"))
    halves = [vectors.block_topk(summaries, asked, k, "id", "vector", group="conversation", same=same, cosine=True).withColumn("half", F.lit(n))
              for n, (k, same) in enumerate(((cfg.batch_summary_limit, True), (cfg.conversation_summary_limit, False)))]
    both = halves[0].unionByName(halves[1]).drop("rank")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "half", "id"))).select("query_id", "id", "score", "rank")


def fuse_weighted(finds: DataFrame, weights: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(query_id, ref, leg, score): finds by the hash of their text, each leg with the query's own weight (query_id, leg, weight; 1 where none is told).

    Every find of a text adds to its score; the first leg in ``ORDER``, at its best rank, lends it the ref.
    """
    nth = F.array_position(F.array(*map(F.lit, ORDER)), F.col("leg"))
    weighed = finds.select("query_id", "leg", "ref", "rank", "key", nth.alias("nth")).join(weights, ["query_id", "leg"], "left")
    part = F.coalesce("weight", F.lit(1.0)) / (rrf_k + F.col("rank"))
    first = F.min(F.struct("nth", "rank", "ref", "leg")).alias("first")
    return weighed.groupBy("query_id", "key").agg(F.round(F.sum(part), 9).alias("score"), first).select("query_id", "first.ref", "first.leg", "score")


def turn_forms(finds: DataFrame, turns: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, text, degrade, abstract, conversation, us): the found turns (query_id, id) in the form that summary, keywords and intents ask for, cut to their words and dated.

    Turns have raw, summary, abstract and inject_raw; how far a summary covers its turn is measured on the must-have terms of the raw text.
    """
    found = finds.select("query_id", "id").distinct().join(turns.select("id", "raw", "summary", "abstract", "inject_raw", "conversation", "us"), "id")
    asked = found.join(legs.small(queries.select("query_id", "keywords", "intents")), "query_id")
    cover = tx.summary_coverage(F.col("summary"), tx.search_terms(F.col("raw")))
    form = asm.representation(F.col("raw"), F.col("summary"), F.col("abstract"), cover, F.coalesce("inject_raw", F.lit(False)), F.col("keywords"), F.col("intents"))
    chosen = asked.withColumn("form", form).withColumn("body", F.col("form.text")).where(F.length("body") > 0)
    body = F.when(asm.holds_any(F.col("body"), F.col("keywords")), tx.truncate_words(F.col("body"), 1500)).otherwise(tx.truncate_words(F.col("body"), 500))
    stamp = F.concat(F.lit("["), F.date_from_unix_date(F.floor(F.col("us") / legs.DAY_US).cast("int")).cast("string"), F.lit("] "))
    return chosen.select("query_id", "id", F.concat(F.coalesce(stamp, F.lit("")), body).alias("text"), F.col("form.degrade").alias("degrade"), F.col("form.abstract").alias("abstract"), "conversation", "us")


def turn_finds(leg: str, found: DataFrame, forms: DataFrame) -> DataFrame:
    """Finds of a leg over turns (query_id, id, rank)."""
    rows = found.select("query_id", "id", "rank").join(forms, ["query_id", "id"])
    return rows.select("query_id", F.lit(leg).alias("leg"), ref("turn", F.col("id")).alias("ref"), "rank", F.md5("text").alias("key"), "text", "degrade", "abstract", "conversation", F.col("id").cast("long").alias("origin"), "us")


def text_finds(leg: str, kind: str, found: DataFrame, conversation: Column | None = None, origin: Column | None = None) -> DataFrame:
    """Finds of a leg whose rows (query_id, id, rank, text) bring their text."""
    none = F.lit(None)
    return found.where(F.length("text") > 0).select(
        "query_id", F.lit(leg).alias("leg"), ref(kind, F.col("id")).alias("ref"), F.col("rank").cast("int").alias("rank"), F.md5("text").alias("key"), "text", none.cast("string").alias("degrade"), none.cast("string").alias("abstract"),
        (none if conversation is None else conversation).cast("long").alias("conversation"), (none if origin is None else origin).cast("long").alias("origin"), none.cast("long").alias("us"),
    )


def chosen(finds: DataFrame, queries: DataFrame, shares: DataFrame, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, ref, leg, score, ...): fused finds with bonuses, at most three of any other conversation and two of a turn.

    ``queries`` has keywords, own (its conversation), intents and topics; ``shares`` (id, share, total) tells how new a turn is in its conversation.
    """
    weights = rt.leg_weights(queries.select("query_id", "intents", "topics"))
    fused = fuse_weighted(finds, weights, cfg.rrf_k)
    rows = fused.join(finds.drop("key", "rank"), ["query_id", "ref", "leg"]).join(legs.small(queries.select("query_id", "keywords", "own")), "query_id")
    newness = shares.select(F.col("id").cast("long").alias("origin"), "share", F.col("total").alias("n_turns"))
    rows = rows.join(newness, "origin", "left")
    raised = rt.bonus(F.col("text"), F.col("keywords"), F.coalesce("share", F.lit(1.0)), F.lit(False), F.coalesce("n_turns", F.lit(0)), cfg)
    order = [F.desc("score"), F.asc("ref")]
    scored = rows.withColumn("score", F.round(F.col("score") * (1 + raised), 9))
    kept = rt.cap_per(scored, ["query_id", "conversation"], order, cfg.max_per_conversation, F.col("conversation").isNull() | F.coalesce(F.col("conversation") == F.col("own"), F.lit(False)))
    kept = rt.cap_per(kept, ["query_id", "origin"], order, cfg.max_per_turn, F.col("origin").isNull())
    return kept.select("query_id", "ref", "leg", "score", "text", "degrade", "abstract", "conversation", "origin")


def within_budget(kept: DataFrame, queries: DataFrame, found_vectors: DataFrame) -> DataFrame:
    """(query_id, ref, leg, place, form, tokens): what a query's budget takes, after coverage of its vector (rows without a vector of their own come first).

    ``found_vectors`` is (origin, found).  A query has at most a few hundred rows here, so a group is small.
    """
    kept = cut(kept)  # coverage and budget both read it
    asked = legs.small(queries.select("query_id", "vector", "budget"))
    placed = kept.join(found_vectors, "origin", "left").join(asked.select("query_id", "vector"), "query_id")
    covered = select.coverage(placed.select("query_id", F.col("ref").alias("id"), "score", F.col("found").alias("vector"), F.col("vector").alias("query")))
    size = lambda c: F.when(F.col(c).isNotNull(), tx.token_estimate(F.col(c)))
    sized = covered.select("query_id", F.col("id").alias("ref")).join(kept, ["query_id", "ref"]).join(asked.select("query_id", "budget"), "query_id")
    sized = sized.select("query_id", F.col("ref").alias("id"), "leg", "score", "budget", tx.token_estimate(F.col("text")).alias("tokens"), size("degrade").alias("summary_tokens"), size("abstract").alias("abstract_tokens"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leg = dict(zip(frame["id"], frame["leg"], strict=True))
        rows = [(key[0], i, leg[i], n, form, t) for n, (i, form, t) in enumerate(select.pack_budget(frame, int(frame["budget"].iloc[0])))]
        return pd.DataFrame(rows, columns=["query_id", "ref", "leg", "place", "form", "tokens"])

    return sized.groupBy("query_id").applyInPandas(run, "query_id long, ref long, leg string, place int, form string, tokens long")
