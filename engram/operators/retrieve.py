"""Retrieval legs, fusion and selection.  Every ranking ends in a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Defaults
from engram.functions import scalars
from engram.functions import text as tx

# Weights of the legs by intent; a leg absent from a row gets nothing from it.
LEGS = ("bm25", "vector", "codex", "procedural", "timeline")
BASE_WEIGHTS = {"bm25": 0.8, "vector": 1.0, "codex": 0.5, "procedural": 0.2, "timeline": 0.6}
PROFILES = {
    "Factual_Retrieval": {"vector": 1.2, "bm25": 0.8, "codex": 0.1, "procedural": 0.1},
    "Utility_Formatting": {"vector": 1.2, "bm25": 0.8, "codex": 0.1, "procedural": 0.1},
    "Troubleshooting": {"vector": 1.0, "bm25": 0.8, "codex": 0.3, "procedural": 1.2},
    "Strategic_Planning": {"vector": 1.0, "bm25": 0.8, "codex": 0.3, "procedural": 1.2},
    "Generation": {"vector": 0.6, "bm25": 0.6, "codex": 1.2, "procedural": 0.1},
    "Ideation": {"vector": 0.6, "bm25": 0.6, "codex": 1.2, "procedural": 0.1},
    "Open_Exploration": {"vector": 0.6, "bm25": 0.6, "codex": 1.2, "procedural": 0.1},
    "Emotional_Processing": {"vector": 1.1, "bm25": 0.6, "codex": 0.9, "procedural": 0.0},
    "Analysis_&_Summarization": {"vector": 1.1, "bm25": 0.6, "codex": 0.9, "procedural": 0.0},
    "Decision_Making": {"vector": 1.1, "bm25": 0.6, "codex": 0.9, "procedural": 0.0},
    "Casual_Banter": {"vector": 0.5, "bm25": 0.2, "codex": 0.0, "procedural": 0.0},
    "Null_Noise": {"vector": 0.5, "bm25": 0.2, "codex": 0.0, "procedural": 0.0},
    "Code_Change": {"procedural": 1.2, "codex": 1.0, "vector": 0.6, "bm25": 0.6},
}
TOPIC_DELTAS = {"Creative_&_Media": {"codex": 0.3}, "Software_&_Tech": {"procedural": 0.4}}


def lexical_overlap(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, hits, rank): distinct query terms a document holds; an equi-join on terms."""
    terms = docs.select(id_col, F.explode(F.array_distinct(tx.letters(F.col(text_col)))).alias("term"))
    hits = terms.join(queries.select("query_id", "term").distinct(), "term").groupBy("query_id", id_col).agg(F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), id_col)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25.

    Term frequencies are counted only for query terms (a semi-join before the
    shuffle).  Words are runs of letters.
    """
    split = docs.select(id_col, tx.letters(F.col(text_col)).alias("w")).withColumn("size", F.size("w"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(F.regexp_count(text_col, F.lit(r"\p{L}+")), F.lit(0))).alias("mean"))
    asked = queries.select("query_id", "term").distinct()
    found = split.select(id_col, "size", F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = found.groupBy(id_col, "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").join(F.broadcast(stats)).select(  # stats is one row
        id_col, "term",
        (F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
         / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))).alias("part"),
    )
    total = scored.join(asked, "term").groupBy("query_id", id_col).agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(legs: dict[str, DataFrame], weights: dict[str, float], k: int, rrf_k: int = 60, key: str = "id") -> DataFrame:
    """(query_id, id, score, leg, rank): weighted reciprocal-rank fusion of legs (query_id, id, rank).

    The first leg in the stated order that found an item is named as its source.
    """
    all_ = None
    for n, (leg, rows) in enumerate(legs.items()):
        part = rows.select("query_id", key, "rank", F.lit(leg).alias("leg"), F.lit(n).alias("nth"), F.lit(float(weights.get(leg, 1.0))).alias("w"))
        all_ = part if all_ is None else all_.unionByName(part)
    fused = all_.groupBy("query_id", key).agg(
        F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 9).alias("score"), F.min_by("leg", "nth").alias("leg")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def leg_weights(rows: DataFrame) -> DataFrame:
    """(query_id, leg, weight) of rows (query_id, intents, topics): the mean of the intents' profiles plus topic deltas."""
    def lookup(table: dict, default: dict | None) -> Column:
        legs = F.array(*map(F.lit, LEGS))
        known = F.map_from_arrays(
            F.array(*[F.lit(f"{name}|{leg}") for name, row in table.items() for leg in row]),
            F.array(*[F.lit(float(x)) for row in table.values() for x in row.values()]),
        )
        names = F.array(*map(F.lit, table))
        base = F.map_from_arrays(F.array(*map(F.lit, LEGS)), F.array(*[F.lit((default or {}).get(x, 0.0)) for x in LEGS]))
        return legs, known, names, base

    legs, known, names, base = lookup(PROFILES, BASE_WEIGHTS)
    _, deltas, _, _ = lookup(TOPIC_DELTAS, None)
    leg = rows.select("query_id", "intents", "topics", F.explode(legs).alias("leg"))
    of_intent = F.transform(
        "intents",
        lambda i: F.when(F.array_contains(names, i), F.coalesce(F.try_element_at(known, F.concat(i, F.lit("|"), F.col("leg"))), F.lit(0.0))).otherwise(
            F.element_at(base, F.col("leg"))
        ),
    )
    mean = F.aggregate(of_intent, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("intents"), F.lit(1))
    blended = F.when(F.size("intents") == 0, F.element_at(base, F.col("leg"))).otherwise(mean)
    extra = F.aggregate(
        F.transform("topics", lambda t: F.coalesce(F.try_element_at(deltas, F.concat(t, F.lit("|"), F.col("leg"))), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
    )
    pinned = F.when(F.col("leg") == "timeline", F.lit(BASE_WEIGHTS["timeline"])).otherwise(F.greatest(F.lit(0.0), blended + extra))
    return leg.select("query_id", "leg", F.round(pinned, 6).alias("weight"))


def bonus(text: Column, keywords: Column, newer_share: Column, is_meta: Column, total: Column, cfg: Defaults = DEFAULTS) -> Column:
    """Sum of keyword, length, recency and meta bonuses, clamped."""
    low, n = F.lower(text), F.size(tx.words(text))
    hit = F.exists(keywords, lambda k: F.contains(low, k) | F.contains(low, F.rtrim(k, F.lit("s"))))
    long = F.when(n > cfg.long_words, cfg.bonus_long).when(n > cfg.substantial_words, cfg.bonus_substantial).when(n < cfg.short_words, cfg.penalty_short).otherwise(0.0)
    recent = F.when(total <= cfg.recency_min_turns, 0.0).when(newer_share < 0.1, cfg.bonus_recent_10).when(newer_share < 0.3, cfg.bonus_recent_30).otherwise(0.0)
    raw = F.when(hit, cfg.bonus_keyword).otherwise(0.0) + long + recent - F.when(is_meta, 0.45).otherwise(0.0)
    return F.least(F.lit(cfg.bonus_max), F.greatest(F.lit(cfg.bonus_min), raw))


def newer_share(turns: DataFrame) -> DataFrame:
    """Turns with the share of later turns in their conversation, and its size."""
    late = Window.partitionBy("conversation_id").orderBy(F.desc("us"))
    total = F.count("*").over(Window.partitionBy("conversation_id"))
    return turns.withColumn("total", total).withColumn("newer", F.rank().over(late) - 1).withColumn("share", F.col("newer") / F.col("total"))


def cap_per(rows: DataFrame, keys: list[str], order: list, n: int, exempt: Column | None = None) -> DataFrame:
    """At most n rows a key in the stated order; exempt rows always stay."""
    keep = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n
    return rows.withColumn("keep", keep if exempt is None else keep | exempt).where("keep").drop("keep")


def era_strata(rows: DataFrame, keys: list[str], per: int = 3, strata: int = 4) -> DataFrame:
    """The ``per`` best rows of each era: rows in order of time, in runs of ceil(n / strata)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("us", "turn_id")) - 1
    eras = rows.withColumn("era", F.floor(at / F.ceil(n / strata)).cast("int"))
    return cap_per(eras, [*keys, "era"], [F.desc("score"), F.asc("turn_id")], per)


def preselect_clusters(scored: DataFrame, cfg: Defaults = DEFAULTS) -> DataFrame:
    """Clusters (query_id, cluster_id, score) within the band of the best, none if the best is weak."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = scored.withColumn("best", best).where((F.col("best") >= cfg.cluster_floor) & (F.col("score") >= cfg.cluster_band * F.col("best"))).drop("best")
    return cap_per(kept, ["query_id"], [F.desc("score"), F.asc("cluster_id")], cfg.cluster_top)


def recency_params(mode: Column, t0: Column, t1: Column, now_us: int, cfg: Defaults = DEFAULTS) -> Column:
    """struct(centre, boost, tau) of a time scope."""
    day = float(scalars.DAY_US)
    as_of = F.struct(((t0 + t1) / 2).cast("long").alias("centre"), F.lit(cfg.recency_boost).alias("boost"), F.greatest(F.lit(cfg.recency_tau_days), (t1 - t0) / day / 2).alias("tau"))
    flat = F.struct(F.lit(now_us).cast("long").alias("centre"), F.lit(0.0).alias("boost"), F.lit(cfg.recency_tau_days).alias("tau"))
    current = F.struct(F.lit(now_us).cast("long").alias("centre"), F.lit(cfg.recency_boost).alias("boost"), F.lit(cfg.recency_tau_days).alias("tau"))
    return F.when(mode == "as_of", as_of).when(mode.isin("range", "evolution"), flat).otherwise(current)


def route_models(queries: DataFrame, models: DataFrame) -> DataFrame:
    """The first model, in order of insertion, with most tags shared; models is a small registry."""
    shared = F.size(F.array_intersect("tags", "model_tags")) + F.col("priority")
    best = lambda rows: rows.groupBy("query_id").agg(F.max_by(F.struct("model", "score"), F.struct("score", F.col("nth") * -1)).alias("r")).select("query_id", "r.*")
    # the registry holds one row a model and travels with the tasks only while it is small; then a query meets it as one array and stays one row
    if models.count() > 10_000:
        return best(queries.join(models, F.col("window") >= F.col("need")).withColumn("score", shared))
    registry = models.agg(F.collect_list(F.struct("model", "model_tags", "priority", "window", "nth")).alias("models"))
    fits = F.filter("models", lambda m: m["window"] >= F.col("need"))
    scored = F.transform(fits, lambda m: F.struct((F.size(F.array_intersect("tags", m["model_tags"])) + m["priority"]).alias("score"), (m["nth"] * -1).alias("last"), m["model"].alias("model")))
    first = queries.join(F.broadcast(registry)).select("query_id", F.array_max(scored).alias("m")).where("m is not null")
    return best(first.select("query_id", "m.model", "m.score", (F.col("m.last") * -1).alias("nth")))


def symbol_lookup(symbols: DataFrame, name: Column, limit: int = 10) -> DataFrame:
    """Symbols equal to a name or ending in .name or :name, shortest first."""
    fits = (F.col("symbol") == name) | F.endswith("symbol", F.concat(F.lit("."), name)) | F.endswith("symbol", F.concat(F.lit(":"), name))
    order = Window.partitionBy("query_id").orderBy(F.length("symbol"), "symbol")
    return symbols.where(fits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

