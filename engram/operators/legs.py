"""The legs of a search, each under the scope of every single query.

A query is (query_id, vector, mode, t0, t1, creative, conversations, excluded, clusters, excluded_clusters); modes are current, as_of,
range and evolution, and null lists are open.  A turn is (id, vector, us, conversation, clusters, decay, is_archived, is_private,
is_document).  Legs return rows with a query_id, a score and a rank that ends in a unique tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.config import DEFAULTS, Defaults
from engram.functions import vectors
from engram.functions.scalars import DAY_US, edge_trust
from engram.lineage import cut
from engram.operators import retrieve as rt

#: Queries are broadcast up to this many rows; beyond that both sides are shuffled.
SMALL = 100_000
#: Sets of one or two ids are broadcast up to this many rows.
KEYS = 1_000_000
WINDOWED = ("as_of", "range")


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if df.count() <= (SMALL if most is None else most) else df


def scopes(queries: DataFrame, now_us: int, cfg: Defaults = DEFAULTS) -> DataFrame:
    """Queries with the centre, boost and decay time of their recency; only as_of and range keep their window, and creative ones have no boost outside as_of."""
    windowed = F.col("mode").isin(*WINDOWED) & F.col("t0").isNotNull() & F.col("t1").isNotNull()
    near = rt.recency_params(F.when((F.col("mode") == "as_of") & ~windowed, "current").otherwise(F.col("mode")), F.col("t0"), F.col("t1"), now_us, cfg)
    flat = F.col("creative") & ~((F.col("mode") == "as_of") & windowed)
    told = queries.withColumn("near", near).withColumns({
        "centre": F.col("near.centre"), "boost": F.when(flat, 0.0).otherwise(F.col("near.boost")), "tau": F.col("near.tau"),
        "t0": F.when(windowed, F.col("t0")), "t1": F.when(windowed, F.col("t1")),
    })
    return told.drop("near")


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return rows.withColumn("rank", F.row_number().over(order))


def turn_leg(turns: DataFrame, queries: DataFrame, now_us: int, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, score, rank): the nearest turns that are no documents; under evolution, the best of each era of a wider find."""
    asked = scopes(queries, now_us, cfg)
    most = max(cfg.vector_limit, cfg.evolution_limit)
    found = vectors.scoped_topk(turns.where(~F.col("is_document")), asked, most, "id", "vector", floor=cfg.visible_decay)
    found = cut(found.join(small(asked.select("query_id", "mode")), "query_id"))
    plain = found.where((F.col("mode") != "evolution") & (F.col("rank") <= cfg.vector_limit))
    wide = found.where((F.col("mode") == "evolution") & (F.col("rank") <= cfg.evolution_limit)).join(turns.select("id", "us"), "id")
    eras = rt.era_strata(wide.withColumn("turn_id", F.col("id")), ["query_id"])
    return _ranked(plain.select("query_id", "id", "score").unionByName(eras.select("query_id", "id", "score")), "id")


def chunk_leg(chunks: DataFrame, turns: DataFrame, queries: DataFrame, hits: DataFrame, now_us: int, per_parent: int = 3, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, parent, score, rank): the nearest chunks (id, parent, vector), seen and weighed as their parent turn is.

    Of the best ``chunk_limit`` at most ``per_parent`` stay a parent; parents among ``hits`` (query_id, id) are covered already.
    The recency centre is the query's, its boost that of the turns.
    """
    of_parent = turns.select(F.col("id").alias("parent"), *vectors.ROW_SCOPE)
    placed = chunks.select("id", "parent", "vector").join(of_parent, "parent")
    found = vectors.scoped_topk(placed, scopes(queries, now_us, cfg), cfg.chunk_limit, "id", "vector", floor=cfg.visible_decay)
    kept = rt.cap_per(found.drop("rank").join(chunks.select("id", "parent"), "id"), ["query_id", "parent"], [F.desc("score"), F.asc("id")], per_parent)
    return _ranked(kept.join(hits.select("query_id", F.col("id").alias("parent")), ["query_id", "parent"], "left_anti").select("query_id", "id", "parent", "score"), "id")


def cold_leg(cold: DataFrame, queries: DataFrame, now_us: int, limit: int = 5, score: float = 0.6, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, distance, score, rank): rows of the cold store inside a query's window, nearest first, then newest; others than windowed queries find none.

    ``cold`` has text besides a turn's columns, ``queries`` keywords (array).  A row with a vector counts by its distance, whatever it says; one
    without counts as distance 1, and only if it holds one of the keywords (or the query has none).  Clusters don't reach
    the cold store.  Both arms keep their own ``limit`` best before they meet, so neither shuffles more than that a query and task.
    """
    asked = queries.where(F.col("mode").isin(*WINDOWED, "evolution") & F.col("t0").isNotNull()).withColumn("t1", F.coalesce("t1", F.lit(now_us)))
    none = F.lit(None).cast("array<long>")
    # outside "current" neither decay nor archive hides a row; recency doesn't weigh
    probes = asked.withColumns({"centre": F.lit(now_us), "boost": F.lit(0.0), "tau": F.lit(cfg.recency_tau_days), "clusters": none, "excluded_clusters": none})
    rows = cold.withColumns({"clusters": F.array().cast("array<long>"), "decay": F.lit(1.0), "is_archived": F.lit(False)})
    order = [F.asc("distance"), F.desc("us"), F.asc("id")]
    near = vectors.scoped_topk(rows, probes, limit, "id", "vector", decayed=False, newest=True)
    met = near.join(rows.select("id", "us"), "id").select("query_id", "id", "us", F.round(1 - F.col("score"), 6).alias("distance"))
    # a mark that is not known hides a row without a vector
    bare = rows.where("vector is null").withColumn("is_private", F.coalesce("is_private", F.lit(True))).withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    lower = F.transform(F.filter("keywords", lambda w: w.isNotNull()), lambda w: F.lower(w))
    # of keywords that are all null none is held, which is not the same as having none
    said = probes.where((F.size("keywords") == 0) | (F.size(lower) > 0)).withColumn("keywords", lower)
    worded = vectors.scoped_newest(bare, said, limit, "id").select("query_id", "id", "us", F.lit(1.0).alias("distance"))
    ranked = met.unionByName(worded).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).select("query_id", "id", "distance", F.lit(score).alias("score"), "rank")


def wide_net(turns: DataFrame, queries: DataFrame, now_us: int, threshold: float = 0.35, limit: int = 100, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, id, score, rank): what a query whose topic and intent are both unsure searches instead: one pass over all turns, documents too, without decay.

    It widens the ranking, not what is seen: scope, window, archive and decay floor are those of the other legs.
    """
    lost = queries.where((F.col("topic_confidence") < threshold) & (F.col("intent_confidence") < threshold))
    return vectors.scoped_topk(turns, scopes(lost, now_us, cfg), limit, "id", "vector", decayed=False, floor=cfg.visible_decay)


def _scope(now_us: int, cfg: Defaults) -> tuple[Column, Column]:
    """For an edge beside a query: whether it is valid under the query's window and in its batches, and its trust there.

    Windowed: valid at the window's end, and trust is fresh near it; else valid now.
    """
    at = F.when(F.col("mode").isin(*WINDOWED), F.col("t1"))
    began = F.col("valid_from").isNull() | (F.col("valid_from") <= at)
    valid = F.when(at.isNull(), F.col("valid_until").isNull()).otherwise(began & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
    batch = lambda c, missing: F.coalesce(F.array_contains(c, F.col("batch")), F.lit(missing))
    open_ = (F.col("batches").isNull() | batch("batches", False)) & (F.col("denied").isNull() | ~batch("denied", True))
    # an edge of the future is as fresh as one of now; under a window nearness counts both ways
    start = F.when(at.isNull(), F.least("valid_from", F.lit(now_us))).otherwise(F.col("valid_from"))
    return valid & open_, edge_trust(F.col("strength"), F.col("confidence"), start, F.coalesce(at, F.lit(now_us)), cfg)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end, in one pass: (node, other, outgoing) and what else an edge carries."""
    end = lambda node, other, out: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(out).alias("outgoing"))
    carried = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(*carried, F.inline(F.array(end("source", "target", True), end("target", "source", False))))


def _takable(edges: DataFrame, told: DataFrame, cfg: Defaults) -> DataFrame:
    """The edges that at least one query's walk might take: positive, strong enough when fresh, not over before all windows' ends nor begun after them."""
    lo, hi = told.agg(F.min(F.when(F.col("mode").isin(*WINDOWED), F.col("t1"))), F.max(F.when(F.col("mode").isin(*WINDOWED), F.col("t1")))).first()
    base = F.coalesce("strength", F.lit(0.0)) * F.coalesce("confidence", F.lit(1.0))
    most = F.greatest(base, base * (1 + cfg.edge_recency_boost))
    kept = edges.where(~F.coalesce("negated", F.lit(False)) & (most >= min(cfg.direct_trust, cfg.deep_trust)))
    live = F.col("valid_until").isNull()
    if lo is None:
        return kept.where(live)
    return kept.where(live | (F.col("valid_until") > lo)).where(live | F.col("valid_from").isNull() | (F.col("valid_from") <= hi))


def scoped_walk(edges: DataFrame, anchors: DataFrame, queries: DataFrame, now_us: int, denied: DataFrame | None = None, depth: int | None = None, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, anchor, node, depth): what each anchor (query_id, anchor) reaches over positive edges in both directions, by the shortest way.

    ``queries`` is (query_id, mode, t0, t1, batches, denied): only edges of the batches (null: all) that are not denied count.  The first hop
    asks for trust of ``direct_trust``, later ones for ``deep_trust``.  No walk enters an entity of ``denied`` (query_id, node) or another anchor
    of its query, and none begins at a denied one.  The edges that any walk may take are made once, with what a hop asks of them, and cut.  A hop shuffles
    those of them that begin at its frontier, and frontiers without their scopes; what it reached is shuffled once.  Each frontier is cut.
    """
    told = queries.select("query_id", "mode", "t1", "batches", "denied")
    scopes_fit = told.count() <= SMALL
    ends = cut(both_ways(_takable(edges, told, cfg).select("source", "target", "strength", "confidence", "valid_from", "valid_until", "batch")).drop("outgoing"))
    shut = anchors.select("query_id", F.col("anchor").alias("node"))
    begun = anchors.select("query_id", "anchor").distinct()
    if denied is not None:
        begun = begun.join(denied.select("query_id", F.col("node").alias("anchor")), ["query_id", "anchor"], "left_anti")
        shut = shut.unionByName(denied.select("query_id", "node"))
    shut = small(cut(shut.distinct()), KEYS)
    seen = frontier = cut(begun.select("query_id", "anchor", F.col("anchor").alias("node"), F.lit(0).alias("depth")))
    counts, trust = _scope(now_us, cfg)
    for n in range(1, (cfg.max_depth if depth is None else depth) + 1):
        floor = cfg.direct_trust if n == 1 else cfg.deep_trust
        nodes = frontier.select("node").distinct()
        begin = ends.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= KEYS else ends
        # a scope is as wide as its lists, so it meets what a frontier has met; scopes too many for that meet the frontier
        met = frontier.drop("depth").join(begin, "node").join(F.broadcast(told), "query_id") if scopes_fit else frontier.drop("depth").join(told, "query_id").join(begin, "node")
        reached = met.where(counts & (trust >= floor)).select("query_id", "anchor", F.col("other").alias("node")).distinct()
        fresh = reached.join(shut, ["query_id", "node"], "left_anti").join(seen, ["query_id", "anchor", "node"], "left_anti")
        frontier = cut(fresh.select("query_id", "anchor", "node", F.lit(n).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def graph_fragments(edges: DataFrame, anchors: DataFrame, queries: DataFrame, walk: DataFrame, now_us: int, links: int = 20, facts: int = 10, transitions: int = 8, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(query_id, leg, anchor, score, reached, text): a note an anchor, and a timeline of those that have a history.

    ``anchors`` is (query_id, anchor, nth, relations): nth is its place among the query's matches, relations are those the prompt asks for.  A note holds
    the anchor's ``links`` strongest links, then its facts of an asked relation (of the strongest ``facts``, those that are trusted); what the walk
    reached is counted, and listed by the walk.  Score: 1 + min(.5, .25 x mean trust of the direct links), .25 more with a fact.  The first two
    anchors with a closed edge (four under evolution) lend a timeline at .9 of that score: their last transitions that meet the window, oldest first.
    """
    told = small(queries.select("query_id", "mode", "t0", "t1", "batches", "denied"))
    key = ["query_id", "anchor"]
    began = walk.where("depth = 0").select(*key)
    asked = cut(anchors.join(began, key).join(told, "query_id"))
    nodes = small(asked.select(F.col("anchor").alias("node")).distinct(), KEYS)
    # the anchors' edges, met once: what each query's scope says of them stays, the scope itself doesn't
    counts, trust = _scope(now_us, cfg)
    listed = F.col("batches").isNull() | F.coalesce(F.array_contains("batches", F.col("batch")), F.lit(False))
    meets = (F.col("t1").isNull() | F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("t1"))) & (F.col("t0").isNull() | F.col("valid_until").isNull() | (F.col("valid_until") > F.col("t0")))
    own = asked.withColumn("node", F.col("anchor")).join(both_ways(edges).join(nodes, "node", "left_semi"), "node").select(
        *key, "edge_id", "other", "outgoing", "relation", "strength", "negated", "valid_from", "valid_until", trust.alias("trust"),
        F.coalesce(counts, F.lit(False)).alias("counts"), listed.alias("listed"), F.coalesce(meets, F.lit(False)).alias("meets"), F.coalesce(F.array_contains("relations", F.col("relation")), F.lit(False)).alias("wanted"),
    )
    own = cut(own.where("counts or listed"))
    live = own.where("counts")
    trusted = F.col("trust") >= cfg.direct_trust
    strongest = Window.partitionBy(*key).orderBy(F.desc("strength"), "edge_id", F.desc("outgoing"))
    arrow = F.when(F.col("outgoing"), F.concat(F.lit("-> "), F.col("relation"), F.lit(" "), F.col("other").cast("string"))).otherwise(F.concat(F.lit("<- "), F.col("relation"), F.lit(" "), F.col("other").cast("string")))
    line = F.concat(F.when(F.col("negated"), "not ").otherwise(""), arrow)
    ordered = lambda rows: rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth_line", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    note = ordered(live.withColumn("nth_line", F.row_number().over(strongest)).where(F.col("nth_line") <= links).withColumn("line", line))
    wanted = live.where("wanted").withColumn("nth_line", F.row_number().over(strongest))
    fact = ordered(wanted.where((F.col("nth_line") <= facts) & trusted).withColumn("line", F.concat(F.lit("fact "), line)))
    mean = live.where(~F.col("negated") & trusted).groupBy(*key).agg(F.avg("trust").alias("mean"))
    count = walk.groupBy(*key).agg((F.count("*") - 1).alias("reached"))
    notes = asked.select(*key, "nth", "mode").join(count, key).join(mean, key, "left").join(note.withColumnRenamed("lines", "note"), key, "left").join(fact.withColumnRenamed("lines", "facts"), key, "left")
    score = F.round(1 + F.least(F.lit(0.5), 0.25 * F.coalesce("mean", F.lit(0.0))) + F.when(F.col("facts").isNotNull(), 0.25).otherwise(0.0), 6)
    notes = cut(notes.withColumn("score", score).withColumn("text", F.concat_ws("\n", F.concat(F.lit("# "), F.col("anchor").cast("string")), "note", "facts")))

    past = own.where("listed").groupBy(*key).agg(F.bool_or(F.col("valid_until").isNotNull()).alias("closed")).where("closed").select(*key)
    order = Window.partitionBy("query_id").orderBy("nth", "anchor")
    cap = F.when(F.col("mode") == "evolution", 4).otherwise(2)
    chosen = notes.join(past, key).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(*key, "score", "reached")
    newest = Window.partitionBy(*key).orderBy(F.desc_nulls_last("valid_from"), F.desc("edge_id"), "outgoing")
    last = own.where("listed and meets").join(chosen.select(*key), key, "left_semi").withColumn("back", F.row_number().over(newest)).where(F.col("back") <= transitions)
    stamp = lambda c, none: F.coalesce(F.date_from_unix_date(F.floor(F.col(c) / DAY_US).cast("int")).cast("string"), F.lit(none))
    told_lines = ordered(last.withColumn("nth_line", -F.col("back")).withColumn("line", F.concat(stamp("valid_from", "?"), F.lit(" to "), stamp("valid_until", "now"), F.lit(" "), line)))
    timeline = chosen.join(told_lines, key).select("query_id", F.lit("timeline").alias("leg"), "anchor", F.round(0.9 * F.col("score"), 6).alias("score"), "reached", F.col("lines").alias("text"))
    return notes.select("query_id", F.lit("codex").alias("leg"), "anchor", "score", "reached", "text").unionByName(timeline)
