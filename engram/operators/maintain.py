"""Upkeep of the store: ledgers, registries, slots, reviews, deletion, entities and their relations.

Write-backs are returned as frames of what to add or change; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.relations import cardinality, normalised
from engram.functions.text import slug

DEFAULT_KIND = "document"


def not_in_ledger(rows: DataFrame, ledger: DataFrame, digest: str = "hash") -> DataFrame:
    """Rows that a replay has not seen: of equal hashes among themselves the first stays, those in the ledger go."""
    first = rows.groupBy(digest).agg(F.min("id").alias("id"))
    return first.join(ledger.select(digest), digest, "left_anti").select("id", digest)


def relation_gaps(triples: DataFrame) -> DataFrame:
    """(relation, n, first_us): relations outside the vocabulary, by how often they were asked for."""
    named = triples.select(normalised(F.col("relation")).alias("relation"), "us")
    return named.where(cardinality(F.col("relation")).isNull()).groupBy("relation").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


def get_or_create(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, entity_id) of every distinct name, entities to create).

    A name is matched by its canonical form (trimmed, lower case) against canonical names and then
    aliases of ``entities`` (entity_id, name, aliases); new ids come from a hash of the canonical form, so a
    repeated run creates the same.
    """
    canonical = lambda c: F.lower(F.trim(c))
    asked = names.select(canonical(F.col("name")).alias("name")).where("length(name) > 0").distinct()
    by_name = entities.select(canonical(F.col("name")).alias("name"), "entity_id", F.lit(0).alias("how"))
    by_alias = entities.select(F.explode("aliases").alias("name"), "entity_id", F.lit(1).alias("how")).select(canonical(F.col("name")).alias("name"), "entity_id", "how")
    known = by_name.unionByName(by_alias).groupBy("name").agg(F.min(F.struct("how", "entity_id"))["entity_id"].alias("entity_id"))
    found = asked.join(known, "name", "left")
    made = F.concat(F.lit("new-"), F.substr(F.sha2("name", 256), F.lit(1), F.lit(16)))
    all_ = found.select("name", F.coalesce(F.col("entity_id").cast("string"), made).alias("entity_id"), F.col("entity_id").isNull().alias("is_new"))
    return all_.select("name", "entity_id"), all_.where("is_new").select("name", "entity_id")


def entity_view(edges: DataFrame, most: int | None = 20, with_expired: bool = False) -> DataFrame:
    """(entity, side, rank, edge_id, other, expired): the ``most`` strongest live edges of every entity on each side, or, without ``most``, all of them.

    With ``with_expired``, edges that have ended come behind the live ones.  With ``most``, a task ranks no more than that many rows an entity and side after its own first ones.
    """
    both = F.array(F.struct(F.col("source").alias("entity"), F.lit("out").alias("side"), F.col("target").alias("other")), F.struct(F.col("target").alias("entity"), F.lit("in").alias("side"), F.col("source").alias("other")))
    rows = edges if with_expired else edges.where("valid_until is null")
    sides = rows.select("edge_id", "strength", F.col("valid_until").isNotNull().alias("expired"), F.inline(both))
    order = Window.partitionBy("entity", "side").orderBy("expired", F.desc("strength"), "edge_id")
    ranked = sides.withColumn("rank", F.row_number().over(order))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("entity", "side", "rank", "edge_id", "other", "expired")


def latest_slots(slots: DataFrame) -> DataFrame:
    """The newest version of each slot (tier, owner, name)."""
    newest = Window.partitionBy("tier", "owner", "name").orderBy(F.desc("version"))
    return slots.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def write_slot(tier: Column, name: Column, text: Column, version: Column, cap: int = 300) -> Column:
    """struct(version, error): the version that a write makes, or why it is refused."""
    error = (
        F.when(~tier.isin("global", "project", "conversation"), "unknown tier").when(~F.rlike(name, F.lit("^[a-z0-9_-]{1,64}$")), "bad name")
        .when(F.floor(F.length(text) / 4) > cap, "too long")
    )
    return F.struct(F.when(error.isNull(), F.coalesce(version, F.lit(0)) + 1).alias("version"), error.alias("error"))


def review(rows: DataFrame, verdict: Column) -> DataFrame:
    """(id, state): pending rows take their verdict (approve or reject); all others, and other verdicts, change nothing."""
    made = F.when(F.col("state") == "pending", F.when(verdict == "approve", "active").when(verdict == "reject", "rejected"))
    return rows.select("id", F.coalesce(made, F.col("state")).alias("state"))


def backlog(documents: DataFrame, chunks: DataFrame, most: int = 50, long_chars: int = 4200) -> DataFrame:
    """(doc_id): documents or long turns without chunks, newest first, ``most`` a run."""
    due = documents.where(F.col("is_document") | (F.length("text") > long_chars))
    return due.join(chunks.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("us"), "doc_id").limit(most).select("doc_id")


def cascade(deleted: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges to delete, entities left without any edge) after the sources ``deleted`` (batch) go."""
    gone = edges.join(deleted, "batch", "left_semi")
    left = edges.join(deleted, "batch", "left_anti")
    ends = lambda e: e.select(F.explode(F.array("source", "target")).alias("entity")).distinct()
    return gone.select("edge_id"), ends(gone).join(ends(left), "entity", "left_anti")


def derived_visible(entities: DataFrame, project: Column) -> DataFrame:
    """Entities that were stated, or derived inside the attached project; without a project no derived ones."""
    return entities.where(~F.col("is_derived") | F.coalesce(F.col("project") == project, F.lit(False)))


def meta_turns(turns: DataFrame, tags: DataFrame) -> DataFrame:
    """(turn_id, is_meta): turns tagged as talk about the memory itself."""
    marked = tags.where(F.col("tag") == "Meta").select("turn_id").distinct().withColumn("is_meta", F.lit(True))
    return turns.select("turn_id").join(marked, "turn_id", "left").select("turn_id", F.coalesce("is_meta", F.lit(False)).alias("is_meta"))


def bounded_verdicts(answers: DataFrame, allowed: tuple[str, ...], answer: str = "answer") -> DataFrame:
    """(id, verdict, why): a model's answers, folded to lower case; what is not allowed is dismissed and kept as such."""
    folded = F.lower(F.trim(F.col(answer)))
    return answers.select("id", F.when(folded.isin(*allowed), folded).otherwise("dismissed").alias("verdict"), F.when(~F.coalesce(folded.isin(*allowed), F.lit(False)), "unknown verdict").alias("why"))


def classified(rows: DataFrame, answer: Column, allowed: tuple[str, ...], default: str = DEFAULT_KIND) -> DataFrame:
    """(id, kind): an injected model's answer as a column expression over a sample of the text; failures become the default."""
    folded = F.lower(F.trim(answer))
    return rows.select("id", F.when(folded.isin(*allowed), folded).otherwise(F.lit(default)).alias("kind"))


def sample_of(text: Column, part: int = 800) -> Column:
    """Head, middle and tail of a text, for a classifier that reads little."""
    n = F.length(text)
    middle = F.substr(text, F.floor(n / 2 - part / 2).cast("int") + 1, F.lit(part))
    return F.when(n <= 3 * part, text).otherwise(F.concat_ws("\n[…]\n", F.substr(text, F.lit(1), F.lit(part)), middle, F.substr(text, (n - part + 1).cast("int"), F.lit(part))))


def session_start(slots: DataFrame, sessions: DataFrame) -> DataFrame:
    """(owner, slots, summary): what a session begins with: the global slots and the last summary."""
    texts = slots.where("tier = 'global'").groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "\n").alias("slots"))
    last = sessions.groupBy("owner").agg(F.max_by("summary", F.struct("us", "session")).alias("summary"))
    return texts.join(last, "owner", "full_outer").select("owner", "slots", "summary")


def reinforced(new: DataFrame, near: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, action, pattern_id): a new pattern strengthens the nearest known one (id, pattern_id, score) if that is near enough, else it is inserted."""
    best = near.groupBy("id").agg(F.max_by(F.struct("pattern_id", "score"), F.struct(F.col("score"), -F.col("pattern_id"))).alias("best"))
    hit = F.coalesce(F.col("best.score") >= threshold, F.lit(False))
    return new.select("id").join(best, "id", "left").select("id", F.when(hit, "reinforce").otherwise("insert").alias("action"), F.when(hit, F.col("best.pattern_id")).alias("pattern_id"))


def due_jobs(jobs: DataFrame, runs: DataFrame, now_us: int, most: int = 96) -> DataFrame:
    """(job, cycles): interval jobs that are due, with the cycles they missed (1 to ``most``); a job that never ran is due once."""
    last = runs.groupBy("job").agg(F.max("us").alias("last"))
    missed = F.floor((F.lit(now_us) - F.col("last")) / F.col("interval_us"))
    rows = jobs.join(last, "job", "left").withColumn("cycles", F.when(F.col("last").isNull(), 1).otherwise(F.least(F.lit(most), missed)).cast("int"))
    return rows.where("cycles >= 1").select("job", "cycles")


def claims(tasks: DataFrame, now_us: int, lease_us: int) -> DataFrame:
    """(task, worker): open tasks, or those whose lease ran out, each to the asking worker that comes first."""
    free = tasks.where((F.col("state") == "open") | ((F.col("state") == "leased") & (F.col("leased_us") + lease_us < now_us)))
    return free.groupBy("task").agg(F.min_by("worker", F.struct("asked_us", "worker")).alias("worker"))


def nearest_above(near: DataFrame, floor: float, most: int) -> DataFrame:
    """(query_id, id, score, rank): finds (query_id, id, score, rank) that reach the floor, ``most`` a query."""
    return near.where((F.col("score") >= floor) & (F.col("rank") <= most)).select("query_id", "id", "score", "rank")


def forgotten(turns: DataFrame, edges: DataFrame, chosen: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """(turns to hide, edges to expire) for the confirmed choices (kind, id): a turn by itself, an entity by its live edges on either side."""
    hidden = turns.join(chosen.where("kind = 'turn'").select(F.col("id").alias("turn_id")), "turn_id", "left_semi").select("turn_id", F.lit(True).alias("is_private"))
    entities = chosen.where("kind = 'entity'").select(F.col("id").alias("entity")).distinct()
    live = edges.where("valid_until is null")
    of = lambda side: live.join(entities, F.col(side) == F.col("entity"), "left_semi").select("edge_id")
    return hidden, of("source").unionByName(of("target")).distinct().withColumn("valid_until", F.lit(now_us).cast("long"))


def overridden(automatic: DataFrame, manual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, is_manual): what a user set stands in place of what was derived; a null set by hand is an answer too."""
    m = manual.select(key, F.col(value).alias("__set"), F.lit(True).alias("is_manual"))
    rows = automatic.select(key, value).join(m, key, "left")
    return rows.select(key, F.when(F.col("is_manual"), F.col("__set")).otherwise(F.col(value)).alias(value), F.coalesce("is_manual", F.lit(False)).alias("is_manual"))


def stale(rows: DataFrame, done: DataFrame, key: str, now_us: int, age_us: int) -> DataFrame:
    """(key, age_us): rows older than ``age_us`` that nothing in ``done`` has settled since."""
    last = done.groupBy(key).agg(F.max("us").alias("__last"))
    open_ = rows.join(last, key, "left").where(F.col("__last").isNull() | (F.col("__last") < F.col("us")))
    return open_.select(key, (F.lit(now_us) - F.col("us")).alias("age_us")).where(F.col("age_us") > age_us)


def journal(edits: DataFrame, keep: int = 5) -> DataFrame:
    """(entity, version, text, is_current): the last ``keep`` versions of each description; equal successive texts are one version."""
    order = Window.partitionBy("entity").orderBy("us", "edit")
    changed = edits.withColumn("__before", F.lag("text").over(order)).where(~F.col("text").eqNullSafe(F.col("__before")) | F.col("__before").isNull())
    placed = changed.withColumn("version", F.row_number().over(order)).withColumn("__last", F.count("*").over(Window.partitionBy("entity")))
    kept = placed.where(F.col("version") > F.col("__last") - keep)
    return kept.select("entity", "version", "text", (F.col("version") == F.col("__last")).alias("is_current"))


def registry(seen: DataFrame) -> DataFrame:
    """(slug, name, first_us, last_us, n): projects by the slug of their name; the newest spelling names them."""
    rows = seen.select(slug(F.col("name")).alias("slug"), "name", "us").where("slug <> ''")
    return rows.groupBy("slug").agg(F.max_by("name", F.struct("us", "name")).alias("name"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"))


def outline(symbols: DataFrame) -> DataFrame:
    """(module, outline): each module's symbols as indented lines, by name; the depth is the number of dots below the module."""
    below = F.substr("symbol", F.length("module") + 2)
    line = F.concat(F.repeat(F.lit("  "), F.size(F.split(below, r"\.")) - 1), F.element_at(F.split(below, r"\."), -1))
    lines = F.transform(F.array_sort(F.collect_set(F.struct("symbol", line.alias("line")))), lambda x: x["line"])
    return symbols.where(F.col("symbol") != F.col("module")).groupBy("module").agg(F.array_join(lines, "\n").alias("outline"))
