"""What the deletion of conversations takes with it, and the deletion itself: one plan for both.

A fact goes only with its last support, so support is counted: an edge that a deleted
turn stated stays if it was also added from elsewhere; an entity goes if none of its live edges is left, unless it was
derived or someone wrote its description; a cluster goes if no member of another conversation is left;
a pattern loses the evidence that goes, and goes with the last of it.  A pattern may rest on other patterns, so that is repeated
until nothing more falls.  ``manifest`` counts exactly the frames that ``apply`` uses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.lineage import cut
from engram.operators.legs import KEYS, small


@dataclass
class Store:
    """The tables of a store.

    turns (turn_id, conversation_id, batch), edges (edge_id, source, target, batch, valid_until, derived),
    added (edge_id, batch): every statement of an edge, entities (entity, derived, authored), members (cluster_id, turn_id),
    chunks (chunk_id, turn_id), evidence (pattern_id, kind, id): turns and patterns that a pattern rests on.
    """

    turns: DataFrame
    edges: DataFrame
    added: DataFrame
    entities: DataFrame
    members: DataFrame
    chunks: DataFrame
    evidence: DataFrame


def plan(store: Store, conversations: DataFrame) -> dict[str, DataFrame]:
    """The ids of what goes, by table: turns, batches, edges, entities, clusters, patterns, and links of the rest that go."""
    turns = cut(store.turns.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_semi").select("turn_id", "batch"))
    live = store.edges.where("valid_until is null")
    # only batches that a statement names are held against statements, so rows are not shuffled by batch for those of all turns
    named = live.select("batch").unionByName(store.added.select("batch")).distinct()
    batches = small(cut(turns.select("batch").distinct().join(named, "batch", "left_semi")), KEYS)
    stated = cut(live.where("not derived").join(batches, "batch", "left_semi").select("edge_id", "source", "target"))
    elsewhere = store.added.where("batch is not null").join(batches, "batch", "left_anti").select("edge_id")
    edges = cut(stated.join(elsewhere, "edge_id", "left_anti"))

    ends = lambda e: e.select(F.explode(F.array("source", "target")).alias("entity")).distinct()
    touched = ends(edges)
    holding = ends(live.join(edges.select("edge_id"), "edge_id", "left_anti"))
    entities = cut(touched.join(holding, "entity", "left_anti").join(store.entities.where("not derived and not authored").select("entity"), "entity", "left_semi"))

    gone = small(turns.select("turn_id"), KEYS)
    links = cut(store.members.join(gone, "turn_id", "left_semi").select("cluster_id", "turn_id").distinct())
    kept = store.members.join(gone, "turn_id", "left_anti").select("cluster_id").distinct()
    clusters = cut(links.select("cluster_id").distinct().join(kept, "cluster_id", "left_anti"))

    # patterns fall with the last of their evidence, level by level; one that a turn or anything else but patterns still bears is left out of the levels
    evidence = store.evidence.select("pattern_id", "kind", "id")
    fell = small(turns.select(F.lit("turn").alias("kind"), F.col("turn_id").alias("id"), F.lit(True).alias("fell")), KEYS)
    marked = evidence.join(fell, ["kind", "id"], "left").withColumn("fell", F.coalesce("fell", F.lit(False)))
    borne = cut(marked.groupBy("pattern_id").agg(F.bool_and("fell").alias("falls"), F.bool_and(F.col("fell") | F.coalesce(F.col("kind") == "pattern", F.lit(False))).alias("may")).where("may"))
    of_patterns = lambda ids: ids.select(F.col("pattern_id").alias("id"))
    patterns = new = cut(borne.where("falls").select("pattern_id"))
    waiting = cut(evidence.where("kind = 'pattern'").join(borne.where("not falls").select("pattern_id"), "pattern_id", "left_semi").select("pattern_id", "id"))
    while not new.isEmpty():
        rest = cut(waiting.join(of_patterns(new), "id", "left_anti").select("pattern_id", "id"))
        new = cut(waiting.select("pattern_id").distinct().join(rest, "pattern_id", "left_anti"))
        patterns, waiting = cut(patterns.unionByName(new)), rest
    lost = evidence.where("kind = 'turn'").join(fell, ["kind", "id"], "left_semi").unionByName(evidence.where("kind = 'pattern'").join(of_patterns(patterns), "id", "left_semi").select("kind", "id", "pattern_id"))
    lost = cut(lost.select("pattern_id", "kind", "id").distinct())
    return {
        "turns": turns.select("turn_id"), "chunks": cut(store.chunks.join(gone, "turn_id", "left_semi").select("chunk_id")), "edges": edges.select("edge_id"), "entities": entities,
        "cluster_links": links, "clusters": clusters, "evidence": lost, "patterns": patterns,
        "kept_edges": cut(stated.select("edge_id").join(edges.select("edge_id"), "edge_id", "left_anti")),
    }


def manifest(planned: dict[str, DataFrame]) -> DataFrame:
    """(store, n): how many rows of each kind go; for ``kept_edges``, how many stay on other support."""
    out = None
    for name, ids in planned.items():
        part = ids.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def apply(store: Store, planned: dict[str, DataFrame], now_us: int) -> Store:
    """The store without what was planned; edges are expired and entities emptied of what would match them, since their history stays."""
    without = lambda rows, name, on: rows.join(planned[name], on, "left_anti")
    turns, edges = without(store.turns, "turns", "turn_id"), planned["edges"].withColumn("__gone", F.lit(True))
    expired = store.edges.join(edges, "edge_id", "left").withColumn("valid_until", F.when(F.col("__gone"), F.lit(now_us).cast("long")).otherwise(F.col("valid_until"))).drop("__gone")
    return Store(
        turns, expired, store.added, without(store.entities, "entities", "entity"), without(store.members, "cluster_links", ["cluster_id", "turn_id"]),
        without(store.chunks, "chunks", "chunk_id"), without(without(store.evidence, "evidence", ["pattern_id", "kind", "id"]), "patterns", "pattern_id"),
    )
