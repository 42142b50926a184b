"""Scope precedence, assembly, label building and the smaller retrieval rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators.ingest import lowest
from engram.operators.similar import linked_groups


def resolve_scope(mode: Column, manual: Column, attached: Column, project: Column, excluded: Column) -> Column:
    """struct(how, ids): a manual scope, else attached conversations, else the project's, else none (null ids); exclusions are taken off."""
    how = F.when(mode == "none", "none").when(F.size(manual) > 0, "manual").when(F.size(attached) > 0, "attached").when(F.size(project) > 0, "project").otherwise("none")
    ids = F.when(how == "manual", manual).when(how == "attached", attached).when(how == "project", project)
    return F.struct(how.alias("how"), F.array_sort(F.array_except(ids, excluded)).alias("ids"))


def payload_match(entities: DataFrame, words: DataFrame, per_word: int = 20, top: int = 2) -> DataFrame:
    """(query_id, entity_id, hits): entities whose payload holds most of a query's words of four letters, also inside longer words; twenty a word at most.

    ``entities`` has entity_id and payload.  The vocabulary of the payloads meets the asked words by
    their first three letters, and only the words that hold them are looked up among the payloads.
    """
    tokens = entities.select("entity_id", F.explode(F.array_distinct(tx.words(F.lower("payload")))).alias("token"))
    asked = words.where(F.length("word") >= 4)
    starts = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda n: F.substr("token", n, F.lit(3)))
    vocabulary = tokens.select("token").distinct().where(F.length("token") >= 4).select("token", F.explode(F.array_distinct(starts)).alias("start"))
    holds = vocabulary.join(asked.select("word", F.substr("word", F.lit(1), F.lit(3)).alias("start")).distinct(), "start").where(F.contains("token", F.col("word")))
    found = tokens.join(holds.select("token", "word"), "token").select("entity_id", "word").distinct()
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy("entity_id"))).where(F.col("nth") <= per_word)
    counts = first.join(asked, "word").groupBy("query_id", "entity_id").agg(F.count("*").alias("hits"))
    best = Window.partitionBy("query_id").orderBy(F.desc("hits"), "entity_id")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).drop("rank")


def expansion(matched: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, terms): names and aliases of matched entities, each once, in order of first use."""
    terms = matched.select("query_id", "place", F.posexplode(F.concat(F.array("name"), "aliases")).alias("n", "term"))
    first = terms.groupBy("query_id", "term").agg(F.min(F.struct("place", "n")).alias("at"))
    kept = first.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "term"))).where(F.col("nth") <= most)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), "|").alias("terms"))


def procedural(scored: DataFrame, fires: Column, limit: int = 5, least: float = 0.3) -> DataFrame:
    """Active, confident patterns: the nearest five, and only then the trigger gate."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pattern_id")
    live = scored.where(F.col("is_active") & (F.col("confidence") >= least))
    return live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).where(fires).select("query_id", "pattern_id", "rank")


def enumeration(prompt: Column, tags: Column, cues: tuple[str, ...] = ("list all", "how many", "which of", "every")) -> Column:
    """A cue of enumeration and a tag among the words."""
    return tx.contains_any(F.lower(prompt), cues) & F.arrays_overlap(tags, tx.words(F.lower(prompt)))


def fit_blocks(blocks: DataFrame, window: int, margin: float = 1.2) -> DataFrame:
    """(request, block, kept): blocks in order of importance, a block that is there twice from its smaller form, stay while their running cost fits the window."""
    order = Window.partitionBy("request").orderBy("priority", "block", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select("request", "block", (F.sum(F.ceil(F.col("tokens") * margin)).over(order) <= window).alias("kept"))


def imports_resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, symbol, confidence): a name in its own module, else anywhere if its last part is unique."""
    own = refs.join(symbols.select("symbol", "module"), (F.concat_ws(".", refs["module"], refs["ref"]) == F.col("symbol")), "left_semi").select("module", "ref", F.concat_ws(".", "module", "ref").alias("symbol"), F.lit(1.0).alias("confidence"))
    last = symbols.groupBy(F.element_at(F.split("symbol", r"\."), -1).alias("ref")).agg(F.min("symbol").alias("symbol"), F.count("*").alias("n")).where("n = 1")
    rest = refs.select("module", "ref").join(own.select("module", "ref"), ["module", "ref"], "left_anti").join(last, "ref").select("module", "ref", "symbol", F.lit(0.6).alias("confidence"))
    return own.unionByName(rest)


def override_merge(base: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """(key, score, source): manual scores replace judged ones; either may stand alone."""
    m = manual.select(key, F.col("score").alias("manual"))
    return base.select(key, F.col("score").alias("judged")).join(m, key, "full_outer").select(key, F.coalesce("manual", "judged").alias("score"), F.when(F.col("manual").isNotNull(), "manual").otherwise("judged").alias("source"))


def ratio_compose(rows: DataFrame, flag: Column, share: float, id_col: str) -> DataFrame:
    """All flagged rows, and as many others (lowest hash first) as keep their share."""
    flagged = rows.agg(F.count_if(flag)).first()[0]
    kept = lowest(rows.where(~flag), F.md5(F.col(id_col).cast("string")), id_col, math.floor(flagged * (1 - share) / share))
    return rows.where(flag).unionByName(kept)


def three_way(labels: Column) -> Column:
    return F.when(F.array_contains(labels, "Needs_Memory"), "memory").when(F.array_contains(labels, "Needs_Live"), "live").otherwise("none")


def multi_hot(labels: Column, known: list[str]) -> Column:
    return F.array_join(F.transform(F.array(*map(F.lit, known)), lambda k: F.array_contains(labels, k).cast("int").cast("string")), "")


def tag_sets(models: DataFrame, mapping: DataFrame) -> DataFrame:
    """(model, tags): hub tags through the map, as a sorted set."""
    return models.select("model", F.explode("hub_tags").alias("hub")).join(mapping, "hub").groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def friends(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(group, id, cluster): unassigned turns of one conversation joined where a pair is similar; those alone get null."""
    found = linked_groups(rows, threshold, normalise=True)
    return found.select("group", "id", F.when(F.col("links") > 0, F.col("component")).alias("cluster"))
