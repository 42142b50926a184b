"""What is around a model: its inputs, and the rules that its replies pass before they are facts.

A model is an injected column (a reply, a probability, a decision); nothing here calls one.
Write-backs are returned as frames of what to add or change; nothing is changed in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import relations
from engram.operators.records import normalise_term

WS = "[ \\t\\n\\r\\f\\x0B]+"
# Cues that a new fact may replace an older one.
SUPERSESSION_CUES = (
    "migrated off", "moved off", "no longer", "stopped using", "switched from", "switched to", "replaced", "instead of",
    "deprecated", "abandoned", "dropped", "gave up on", "used to", "moved away from", "ditched",
)
# Relations that exclude each other.
OPPOSITES = (("friend", "enemy"), ("ally", "enemy"), ("married_to", "is_divorced_from"), ("is_dating", "is_separated_from"), ("endorses", "criticises"))
# Words of a relation that say nothing about its meaning, objects that are no things, confidences.
EMPTY_WORDS = ("by", "of", "in", "to", "at", "on", "from", "is", "the", "with", "for")
NO_OBJECTS = ("blush", "laugh", "cry", "smile", "angry", "sad", "happy", "mad")
GROUNDED, UNGROUNDED, REJECTED = 0.9, 0.7, 0.35


# --- classification ------------------------------------------------------------------------------

def context_reliance(memory: Column, live: Column) -> Column:
    """struct(label, p_ltm, p_rts, confidence) of two independent chances; the confidence is the lead over the runner-up.

    A null chance is 0; of equal chances the earlier of Zero_Shot, Long_Term_Memory, Real_Time_Search wins.
    """
    m, r = F.coalesce(memory, F.lit(0.0)), F.coalesce(live, F.lit(0.0))
    zero = 1 - F.greatest(m, r)
    best = F.greatest(zero, m, r)
    label = F.when(zero == best, "Zero_Shot").when(m == best, "Long_Term_Memory").otherwise("Real_Time_Search")
    return F.struct(label.alias("label"), m.alias("p_ltm"), r.alias("p_rts"), (best - F.sort_array(F.array(zero, m, r))[1]).alias("confidence"))


def tags_above(labels: list[str], chances: Column, threshold: float) -> Column:
    """The labels whose chance is above the threshold; if none is, the first likeliest."""
    pairs = F.zip_with(F.array(*map(F.lit, labels)), chances, lambda label, p: F.struct(label.alias("label"), p.alias("p")))
    above = F.transform(F.filter(pairs, lambda x: x["p"] > threshold), lambda x: x["label"])
    likeliest = F.element_at(F.array(*map(F.lit, labels)), F.array_position(chances, F.array_max(chances)).cast("int"))
    return F.when(F.size(above) > 0, above).otherwise(F.array(likeliest))


def label_row(heads: list[list[str]], context: list[str], tags: Column, context_tags: Column, single: Column, version: Column) -> Column:
    """struct(labels, mask): the multi-hot row of all heads and the context head; the mask is false where the row has no context label.

    A row of schema version 2 or later without context labels says "none of them", which is a label too.
    """
    some = F.arrays_overlap(context_tags, F.array(*map(F.lit, context)))
    found = F.when(some, context_tags).when(version >= 2, F.array().cast("array<string>")).otherwise(F.array(single))
    hot = lambda names, given: [F.coalesce(F.array_contains(given, n), F.lit(False)).cast("int") for n in names]
    cells = [c for head in heads for c in hot(head, tags)] + hot(context, found)
    return F.struct(F.array(*cells).alias("labels"), F.coalesce(some | (version >= 2) | single.isin(*context), F.lit(False)).alias("mask"))


def exchange_context(exchanges: DataFrame, n: int = 3, turn_words: int = 150, most: int = 500, least: int = 20) -> DataFrame:
    """(conversation, exchange, context): the last ``n`` exchanges before each, every one cut to ``turn_words``, within ``most`` words.

    An exchange beyond the budget is cut to what is left of it if that is more than ``least`` words, and ends the context.
    Rows: (conversation, exchange, text); blank texts are no context.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), WS, " ")), " ")
    cut = F.when(F.size(words) > turn_words, F.concat(F.array_join(F.slice(words, 1, turn_words), " "), F.lit("…"))).otherwise(F.array_join(words, " "))
    rows = exchanges.select("conversation", "exchange", cut.alias("own"), F.least(F.size(words), F.lit(turn_words)).alias("n_words"))
    order = Window.partitionBy("conversation").orderBy("exchange")
    for k in range(n, 0, -1):
        rows = rows.withColumn(f"t{k}", F.coalesce(F.lag("own", k).over(order), F.lit(""))).withColumn(f"w{k}", F.when(F.col(f"t{k}") == "", 0).otherwise(F.lag("n_words", k).over(order)))
    before, parts, open_ = F.lit(0), [], F.lit(True)
    for k in range(n, 0, -1):
        text, size = F.col(f"t{k}"), F.col(f"w{k}")
        fits, left = before + size <= most, F.lit(most) - before
        short = F.when(left > least, F.concat(F.array_join(F.slice(F.split(text, " "), F.lit(1), F.greatest(left, F.lit(0))), " "), F.lit("…")))
        parts.append(F.when(open_ & (text != ""), F.when(fits, text).otherwise(short)))
        open_, before = open_ & fits, before + size
    return rows.select("conversation", "exchange", F.concat_ws("\n", *parts).alias("context"))


# --- relations of a prompt ------------------------------------------------------------------------

def _stem(word: Column) -> Column:
    """Lower case without the first ending that a word of more than four letters has."""
    w = F.lower(word)
    return F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ing|ed|es|s)$", "")).otherwise(w)


def detected_relations(prompts: DataFrame, near: DataFrame | None = None, floor: float = 0.45, most: int = 5) -> DataFrame:
    """(prompt_id, relation, how) of prompts (prompt_id, text): relations all of whose content words occur, by stem.

    ``near`` (prompt_id, relation, score): similarities of the relations' glosses from the injected
    encoder; those at ``floor`` or more add the best ``most`` that the words did not find.
    The vocabulary is fixed, so its side of the join is bounded.
    """
    spark = prompts.sparkSession
    names = sorted(relations.PROPERTIES | relations.MULTI_VALUED | relations.SINGLE_VALUED)
    lexemes = spark.createDataFrame([(r, w) for r in names for w in set(r.split("_")) - set(EMPTY_WORDS)], "relation string, word string")
    lexemes = lexemes.select("relation", _stem(F.col("word")).alias("stem")).distinct()
    needed = lexemes.groupBy("relation").agg(F.count("*").alias("needed"))
    bare = lambda w: F.regexp_replace(w, "^[.,!?'\"]+|[.,!?'\"]+$", "")
    stems = F.array_distinct(F.transform(F.split(F.lower("text"), WS), lambda w: _stem(bare(w))))
    hits = prompts.select("prompt_id", F.explode(stems).alias("stem")).join(F.broadcast(lexemes), "stem")
    by_words = hits.groupBy("prompt_id", "relation").agg(F.count("*").alias("n")).join(F.broadcast(needed), "relation").where("n = needed")
    found = by_words.select("prompt_id", "relation", F.lit("words").alias("how"))
    if near is None:
        return found
    rest = near.where(F.col("score") >= floor).join(found, ["prompt_id", "relation"], "left_anti")
    best = rest.withColumn("nth", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("score"), F.desc("relation")))).where(F.col("nth") <= most)
    return found.unionByName(best.select("prompt_id", "relation", F.lit("gloss").alias("how")))


# --- extraction ------------------------------------------------------------------------------------

def triples(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((subject, relation, object, negated, confidence), gaps (id, relation)) of replies (id, reply, entities).

    A reply that is no list of objects gives nothing.  Relations are mapped to the vocabulary, and what
    does not map is a gap; objects that are no things and facts of a term about itself go.  A fact whose two terms are
    among the confirmed entities is grounded; without entities nothing can be.  Of equal facts the most certain stays.
    """
    fields = "array<struct<subject:string,relation:string,object:string,negated:boolean>>"
    facts = replies.select("id", "entities", F.inline(F.from_json("reply", fields))).where("subject is not null and relation is not null and object is not null")
    facts = facts.withColumn("asked", F.col("relation")).withColumn("relation", relations.normalised(F.col("relation")))
    known = relations.cardinality(F.col("relation")).isNotNull()
    gaps = facts.where(~known).select("id", F.col("asked").alias("relation"))
    sure = F.transform(F.coalesce("entities", F.array().cast("array<string>")), normalise_term)
    s, o = normalise_term(F.col("subject")), normalise_term(F.col("object"))
    confidence = F.when(F.size(sure) == 0, UNGROUNDED).when(F.array_contains(sure, s) & F.array_contains(sure, o), GROUNDED).otherwise(REJECTED)
    kept = facts.where(known & ~F.lower(F.trim("object")).isin(*NO_OBJECTS) & (s != o))
    rows = kept.select(
        F.lower(F.trim("subject")).alias("subject"), "relation", F.lower(F.trim("object")).alias("object"), F.coalesce("negated", F.lit(False)).alias("negated"), confidence.alias("confidence")
    )
    return rows.groupBy("subject", "relation", "object", "negated").agg(F.max("confidence").alias("confidence")), gaps


def decisions(replies: DataFrame) -> DataFrame:
    """(id, decision, rationale, alternatives, files, type) of replies (id, cue, reply); a reply without a decision gives nothing.

    Fields are bounded; a type that is none of the three is the cue's.
    """
    made = F.from_json("reply", "decision string, rationale string, alternatives_rejected array<string>, files_affected array<string>, type string")
    rows = replies.select("id", "cue", made.alias("r")).withColumn("decision", F.trim("r.decision")).where("length(decision) > 0")
    bounded = lambda c, n, size: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), lambda x: F.left(x, F.lit(size)))
    kind = F.lower(F.trim("r.type"))
    return rows.select(
        "id", F.left("decision", F.lit(500)).alias("decision"), F.left(F.trim(F.coalesce("r.rationale", F.lit(""))), F.lit(1000)).alias("rationale"),
        bounded("r.alternatives_rejected", 6, 200).alias("alternatives"), bounded("r.files_affected", 10, 300).alias("files"),
        F.when(kind.isin("decision", "constraint", "incident"), kind).otherwise(F.col("cue")).alias("type"),
    )


def joined_slices(turns: DataFrame) -> DataFrame:
    """(title, pos, role, text, us) of turns (title, mtime_us, pos, role, text) of overlapping slices of one dump.

    Of turns with the same letters and digits the first stays (turns without any all do); times end at
    the file's own and lie a minute apart.
    """
    same = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    key = F.when(same != "", same).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))
    first = turns.withColumn("__key", F.sha2(key, 256)).withColumn("__nth", F.row_number().over(Window.partitionBy("title", "__key").orderBy("pos"))).where("__nth = 1")
    after = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("pos"))) - 1
    return first.select("title", "pos", "role", "text", (F.col("mtime_us") - after * 60_000_000).alias("us"))


def snippets(members: DataFrame, first: int = 10, least: int = 20, words: int = 200) -> DataFrame:
    """(cluster, snippets): what a model is shown to name a cluster; the first members (cluster, id, text) of ``least`` words or more, cut to ``words``.

    Lines that number a chapter are no theme and are left out.
    """
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    split = lambda c: F.filter(F.split(c, WS), lambda w: w != "")
    rows = members.select("cluster", "id", "text").withColumn("__nth", nth).where(F.col("__nth") <= first).where(F.size(split(F.col("text"))) >= least)
    shown = F.array_join(F.slice(split(F.regexp_replace("text", r"(?im)^.*\bchapter[ \t]*[0-9]+.*$", "")), 1, words), " ")
    lists = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", shown.alias("shown")))).alias("l"))
    return lists.select("cluster", F.array_join(F.transform("l", lambda x: x["shown"]), "\n\n").alias("snippets"))


# --- conflicts -------------------------------------------------------------------------------------

def has_supersession_cue(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in SUPERSESSION_CUES))


def conflicts(new: DataFrame, edges: DataFrame, opposites=OPPOSITES, multi=None) -> DataFrame:
    """(id, kind, old_edge) of new facts (id, source, relation, target, cue) against live edges (edge_id, source, relation, target).

    A live opposite between the same two is an ``antonym``; else, with a cue, a live edge of the same multi-valued relation
    to another target is a ``supersession``.  Of several the least edge is named; edges are aggregated before they meet the facts.
    """
    spark = new.sparkSession
    both = F.broadcast(spark.createDataFrame([*opposites, *[(b, a) for a, b in opposites]], "relation string, opposite string"))
    per = edges.groupBy("source", "relation", "target").agg(F.min("edge_id").alias("edge"))
    asked = new.join(both, "relation").select("id", "source", "target", F.col("opposite").alias("relation"))
    opposed = asked.join(per, ["source", "relation", "target"]).groupBy("id").agg(F.min("edge").alias("opposed"))
    least = per.groupBy("source", "relation").agg(F.min(F.struct("edge", "target")).alias("a"))
    other = per.join(least, ["source", "relation"]).where(F.col("target") != F.col("a.target")).groupBy("source", "relation").agg(F.min("edge").alias("second"))
    held = least.join(other, ["source", "relation"], "left")
    many = F.col("relation").isin(*sorted(relations.MULTI_VALUED if multi is None else multi))
    cued = new.where(F.col("cue") & many).join(held, ["source", "relation"]).select("id", F.when(F.col("a.target") != F.col("target"), F.col("a.edge")).otherwise(F.col("second")).alias("replaced"))
    rows = new.select("id").join(opposed, "id", "left").join(cued, "id", "left").withColumn("old_edge", F.coalesce("opposed", "replaced")).where("old_edge is not null")
    return rows.select("id", F.when(F.col("opposed").isNotNull(), "antonym").otherwise("supersession").alias("kind"), "old_edge")


def reconciled(found: DataFrame) -> DataFrame:
    """(id, write, expire, review) of conflicts (id, kind, old_edge, decision): an opposite is replaced; else the injected decision holds, and an unclear one goes to review."""
    d, antonym = F.coalesce("decision", F.lit("review")), F.col("kind") == "antonym"
    expire = F.when(antonym | (d == "expire_old"), F.col("old_edge"))
    return found.select("id", (antonym | (d != "reject_new")).alias("write"), expire.alias("expire"), (~antonym & ~d.isin("expire_old", "keep_both", "reject_new")).alias("review"))


def leftovers(reviews: DataFrame, attempts: int = 2, most: int = 50) -> DataFrame:
    """The oldest ``most`` pending reconciliations that were tried fewer than ``attempts`` times; the limit is the feature (a run's work)."""
    open_ = reviews.where((F.col("kind") == "codex_reconciliation") & (F.col("status") == "pending") & (F.coalesce("attempts", F.lit(0)) < attempts))
    return open_.orderBy("created_us", "id").limit(most)


def agent_run(items: DataFrame, most_decisions: int = 25, most_applied: int = 10, most_proposed: int = 5, scanned: int = 50) -> DataFrame:
    """(id, outcome) of a maintenance run over items (id, priority, needs_model, effect): apply, propose or none, as the injected decisions say.

    Items are taken by priority, ``scanned`` at most (a run's work), so what the ranks see is bounded.
    A spent budget skips what needs it.
    """
    rows = items.orderBy("priority", "id").limit(scanned)
    nth = lambda c: F.sum(c.cast("int")).over(Window.partitionBy(F.lit(0)).orderBy("priority", "id"))
    rows = rows.withColumn("no_model", F.col("needs_model") & (nth(F.col("needs_model")) > most_decisions))
    apply, propose = (~F.col("no_model") & (F.col("effect") == x) for x in ("apply", "propose"))
    rows = rows.withColumn("full", (apply & (nth(apply) > most_applied)) | (propose & (nth(propose) > most_proposed)))
    return rows.select("id", F.when(F.col("no_model") | F.col("full"), "skipped_cap").when(F.col("effect") == "apply", "applied").when(F.col("effect") == "propose", "proposed").otherwise("none").alias("outcome"))


# --- store -----------------------------------------------------------------------------------------

def cold_moves(turns: DataFrame, cold: DataFrame, below: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(rows to add to the cold store, ids to delete from the hot one): archived turns that decayed below; a cold row that is there already stays as it is."""
    gone = turns.where(F.col("is_archived") & (F.col("decay") < below))
    return gone.join(cold.select("turn_id"), "turn_id", "left_anti"), gone.select("turn_id")


def to_reembed(rows: DataFrame, stamps: DataFrame) -> DataFrame:
    """(kind, id, source) still to encode, of rows (kind, id, text): beyond the last id that its kind's stamp (kind, last_id) names; blank texts have nothing to encode."""
    left = rows.join(F.broadcast(stamps), "kind", "left").where(F.col("last_id").isNull() | (F.col("id") > F.col("last_id")))
    return left.select("kind", "id", F.trim("text").alias("source")).where("length(source) > 0")


def latched(toggles: DataFrame) -> DataFrame:
    """(document, enabled_in, shared_us) of toggles (document, conversation, enabled, us, seq).

    A document's knowledge is shared for ever from the moment a second conversation first enables it;
    what is enabled in a conversation is its last toggle.
    """
    each = toggles.groupBy("document", "conversation").agg(F.min(F.when(F.col("enabled"), F.col("us"))).alias("first_us"), F.max_by("enabled", F.struct("us", "seq")).alias("now"))
    # ranks are cut to two where the rows are, before they are shuffled
    two = each.where("first_us is not null").withColumn("nth", F.row_number().over(Window.partitionBy("document").orderBy("first_us", "conversation"))).where("nth <= 2")
    second = two.where("nth = 2").select("document", F.col("first_us").alias("shared_us"))
    return each.groupBy("document").agg(F.sum(F.col("now").cast("int")).alias("enabled_in")).join(second, "document", "left").select("document", "enabled_in", "shared_us")


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(canonical, action): what a new parse (canonical, payload) does to the stored symbols: insert, update, delete; equal ones stay."""
    rows = old.select("canonical", F.col("payload").alias("was")).join(new.select("canonical", F.col("payload").alias("is")), "canonical", "full_outer")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when(F.col("was") != F.col("is"), "update")
    return rows.select("canonical", action.alias("action")).where("action is not null")


def edit_digests(files: DataFrame) -> DataFrame:
    """(project, digest) of edited files (project, path, mtime, size; null: deleted): an equal digest means that the same edits were read already."""
    part = F.concat_ws("|", "path", F.coalesce("mtime", F.lit(-1)).cast("string"), F.coalesce("size", F.lit(-1)).cast("string"))
    return files.groupBy("project").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(part)), "\n")).alias("digest"))


def commit_links(commits: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project, task, commit) to add: commits (project, commit) go to the project's active task, else to its newest pending one (project, task, status, us, commits)."""
    rank = F.struct((F.col("status") == "active").cast("int"), "us", "task")
    chosen = tasks.where(F.col("status").isin("active", "pending")).groupBy("project").agg(F.max_by(F.struct("task", "commits"), rank).alias("t"))
    rows = commits.distinct().join(chosen, "project").where(~F.array_contains(F.col("t.commits"), F.col("commit")))
    return rows.select("project", F.col("t.task").alias("task"), "commit")
