"""From legs to a prompt: fusion by text, fragments, recent window, assembly, stream parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx

# Intents that want exact words, and those that bear a summary.
PREFER_RAW = ("Factual_Retrieval", "Utility_Formatting", "Troubleshooting", "Code_Change")
PREFER_SUMMARY = ("Casual_Banter", "Ideation", "Open_Exploration", "Emotional_Processing")
CHUNK_BREAK = "\n[…]\n"


def fuse(legs: dict[str, DataFrame], weights: dict[str, float], k: int | None, rrf_k: int = 60) -> DataFrame:
    """(query_id, id, score, leg, rank): weighted reciprocal-rank fusion of legs (query_id, id, rank, key) by the hash of a text.

    Every find of a text adds to its score; the first leg in the stated order that found it, at its best rank, lends it the id.
    """
    parts = [
        rows.select("query_id", "id", "rank", "key", F.lit(leg).alias("leg"), F.lit(n).alias("nth"), F.lit(float(weights.get(leg, 1.0))).alias("w"))
        for n, (leg, rows) in enumerate(legs.items())
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    fused = found.groupBy("query_id", "key").agg(
        F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("nth", "rank", "id", "leg")).alias("first")
    )
    ranked = fused.select("query_id", "first.id", "score", "first.leg").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    )
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def simple_merge(legs: list[DataFrame]) -> DataFrame:
    """(query_id, id, score, rank): all finds by raw score, one a text; legs are (query_id, id, score, key)."""
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    one = every.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return one.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")


def set_floor(candidates: DataFrame, floor: float) -> DataFrame:
    """A query keeps its candidates only if the best of them reaches the floor."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return candidates.withColumn("__best", best).where(F.col("__best") >= floor).drop("__best")


def holds_any(text: Column, keywords: Column) -> Column:
    """Does a text hold a keyword, or the keyword without its plural s?"""
    low = F.lower(text)
    return F.exists(keywords, lambda k: F.contains(low, k) | F.contains(low, F.rtrim(k, F.lit("s"))))


def representation(raw: Column, summary: Column, abstract: Column, cover: Column, inject_raw: Column, keywords: Column, intents: Column) -> Column:
    """struct(text, degrade, abstract): which form of a turn is read, and what it may shrink to.

    A missing or untrusted summary leaves the raw text; so does a keyword that only the raw text holds;
    then the intents decide, then the hint stored with the turn.
    """
    none = F.lit(None).cast("string")
    form = lambda text, degrade, short: F.struct(text.alias("text"), degrade.alias("degrade"), short.alias("abstract"))
    whole, only = form(raw, none, none), form(summary, none, abstract)
    both = form(raw, summary, abstract)
    wants_raw = F.arrays_overlap(intents, F.array(*map(F.lit, PREFER_RAW)))
    wants_summary = F.arrays_overlap(intents, F.array(*map(F.lit, PREFER_SUMMARY))) & ~wants_raw
    return (
        F.when(F.coalesce(F.length(raw), F.lit(0)) == 0, F.when(F.coalesce(F.length(summary), F.lit(0)) > 0, only).otherwise(form(none, none, none)))
        .when(F.coalesce(F.length(summary), F.lit(0)) == 0, F.when(inject_raw, whole).otherwise(form(F.substr(raw, F.lit(1), F.lit(300)), none, none)))
        .when(cover < 0.7, whole)
        .when(holds_any(raw, keywords) & ~holds_any(summary, keywords), whole)
        .when(wants_summary, only)
        .when(wants_raw | inject_raw, both)
        .otherwise(only)
    )


def pick_chunks(chunks: DataFrame, limit: int = 2) -> DataFrame:
    """(query_id, doc_id, text): of each document the chunks with most of the keywords, in their order; without hits the first chunk.

    ``chunks`` has query_id, doc_id, chunk, text and keywords.
    """
    low = F.lower("text")
    hits = F.size(F.filter("keywords", lambda k: F.contains(low, k) | F.contains(low, F.rtrim(k, F.lit("s")))))
    scored = chunks.withColumn("hits", hits)
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("hits"), "chunk")
    ranked = scored.withColumn("nth", F.row_number().over(best)).withColumn("most", F.max("hits").over(Window.partitionBy("query_id", "doc_id")))
    kept = ranked.where(F.col("nth") <= F.when(F.col("most") > 0, limit).otherwise(1))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    return kept.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), CHUNK_BREAK).alias("text"))


def fragments(rows: DataFrame, cap: int = 500, keyword_cap: int = 1500, bookmarked: float = 0.5) -> DataFrame:
    """(id, text, score): rows (id, text, keywords, score, is_bookmarked, day) as fragments, cut to their words, weighted and dated."""
    body = F.when(holds_any(F.col("text"), F.col("keywords")), tx.truncate_words(F.col("text"), keyword_cap)).otherwise(tx.truncate_words(F.col("text"), cap))
    made = rows.withColumn("body", body).where(F.length("body") > 0)
    return made.select(
        "id", F.concat(F.lit("["), F.date_format("day", "yyyy-MM-dd"), F.lit("] "), "body").alias("text"),
        F.when(F.col("is_bookmarked"), F.col("score") * (1 + bookmarked)).otherwise(F.col("score")).alias("score"),
    )


#: A pause of this length ends a sitting; turns of the sitting before that come along; turns of a window at most.
SITTING_US, BRIDGE_TURNS, WINDOW_TURNS = 1_800_000_000, 1, 40


def recent_window(turns: DataFrame, budget: int, share: float = 0.35, gap_us: int = SITTING_US, bridge: int = BRIDGE_TURNS, most: int = WINDOW_TURNS) -> DataFrame:
    """(conversation_id, turn_id, nth, form, cost): the newest turns of the current sitting that fit, and the last of the sitting before.

    ``turns`` has us, tokens, summary_tokens and abstract_tokens (null: none).  A sitting goes back from the newest turn as long as
    no pause reaches ``gap_us``; ``bridge`` turns before it come along, so that a short break does not cut the thread.  A turn
    beyond its share of the budget shrinks first; the newest always stays, and from the first turn on that doesn't fit
    all older ones are left out.  ``nth`` counts from the newest.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("us"), F.desc("turn_id"))
    last = turns.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most)
    pause = F.coalesce((F.lag("us").over(newest) - F.col("us") >= gap_us).cast("int"), F.lit(0))
    until = newest.rowsBetween(Window.unboundedPreceding, 0)
    sat = last.withColumn("pause", pause).withColumn("before", F.sum("pause").over(until))
    sitting = F.sum((F.col("before") == 0).cast("int")).over(Window.partitionBy("conversation_id"))
    kept = sat.withColumn("sitting", sitting).where(F.col("nth") <= F.col("sitting") + bridge)
    cap = max(64, int(budget * share))
    fits = lambda c: F.col(c).isNotNull() & (F.col(c) <= cap)
    form = F.when(F.col("tokens") <= cap, "raw").when(fits("summary_tokens"), "summary").when(fits("abstract_tokens"), "abstract").otherwise("cut")
    cost = F.when(F.col("form") == "raw", F.col("tokens")).when(F.col("form") == "summary", F.col("summary_tokens")).when(F.col("form") == "abstract", F.col("abstract_tokens")).otherwise(cap)
    placed = kept.withColumn("form", form).withColumn("cost", cost.cast("long")).withColumn("used", F.sum("cost").over(until))
    return placed.where((F.col("nth") == 1) | (F.col("used") <= budget)).select("conversation_id", "turn_id", "nth", "form", "cost")


# The order of a prompt's parts.
SECTIONS = ("system", "global", "project", "conversation", "session", "summary", "bookmarks", "recent", "fragments", "question")


def assemble(parts: DataFrame) -> DataFrame:
    """(request, prompt, n_parts): the parts (request, section, place, text) of each request in the order of the sections."""
    at = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    rows = parts.where(F.coalesce(F.length("text"), F.lit(0)) > 0).select("request", at.alias("at"), "place", "text").where("at > 0")
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "place", "text"))), lambda x: x["text"])
    return rows.groupBy("request").agg(F.array_join(line, "\n\n").alias("prompt"), F.count("*").alias("n_parts"))


def parse_stream(stream: Column) -> Column:
    """struct(text, lines, parsed, no_content, salvaged, dropped) of a server-sent event stream of chat deltas.

    A line that is no JSON lends its content string if that is whole, and is counted either way.
    """
    lines = F.transform(F.split(F.coalesce(stream, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    data = F.filter(lines, lambda x: F.startswith(x, F.lit("data:")) & (x != "data: [DONE]"))

    def read(line: Column) -> Column:
        payload = F.regexp_replace(F.substr(line, F.lit(6)), r"^\s+|\s+$", "")
        whole = F.get_json_object(payload, "$").isNotNull()
        rescued = F.nullif(F.regexp_extract(payload, r'"content"\s*:[ \t]*("(?:[^"\\]|\\.)*")', 1), F.lit(""))
        content = F.when(whole, F.get_json_object(payload, "$.choices[0].delta.content")).otherwise(
            F.get_json_object(F.concat(F.lit('{"c":'), rescued, F.lit("}")), "$.c")
        )
        kind = F.when(whole, F.when(F.length(content) > 0, "parsed").otherwise("no_content")).otherwise(F.when(content.isNotNull(), "salvaged").otherwise("dropped"))
        return F.struct(kind.alias("kind"), F.coalesce(content, F.lit("")).alias("content"))

    read_lines = F.transform(data, read)
    count = lambda kind: F.size(F.filter(read_lines, lambda x: x["kind"] == kind)).alias(kind)
    return F.struct(
        F.array_join(F.transform(read_lines, lambda x: x["content"]), "").alias("text"), F.size(data).alias("lines"),
        *map(count, ("parsed", "no_content", "salvaged", "dropped")),
    )


def graph_leg(facts: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, anchor, score, rank): the anchors of each query by 1 + min(.5, .25 x mean trust), .25 more where an asked relation was met."""
    scored = facts.groupBy("query_id", "anchor").agg(F.avg("trust").alias("mean"), F.max(F.col("relation") == F.col("asked")).alias("hit"))
    score = 1 + F.least(F.lit(0.5), 0.25 * F.col("mean")) + F.when(F.col("hit"), 0.25).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "anchor")
    ranked = scored.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "anchor", "score", "rank")


def wide_net_budget(topic: Column, intent: Column, budget: Column, threshold: float = 0.35, share: float = 0.3, least: int = 1500) -> Column:
    """The budget of the fallback search where both heads are unsure; null where either is sure."""
    return F.when((topic < threshold) & (intent < threshold), F.greatest(F.lit(least), F.floor(budget * share)).cast("long"))


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities (entity_id, name) whose name occurs in a text (query_id, text), whatever its case.

    Names meet texts on their first word, so the join is by key; the rest of the name is checked on what meets.
    A first word must begin at a word's border.
    """
    first = F.element_at(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), 1)
    # words travel without their texts; a text comes back for the names it met
    words = texts.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    asked = names.select("entity_id", F.lower("name").alias("name"), first.alias("word")).where("length(word) > 0")
    met = words.join(asked, "word").select("query_id", "entity_id", "name")
    return met.join(texts.select("query_id", F.lower("text").alias("low")), "query_id").where(F.contains("low", F.col("name"))).select("query_id", "entity_id").distinct()
