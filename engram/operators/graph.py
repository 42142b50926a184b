"""Bi-temporal graph reads, detectors and rewrites over edges

(edge_id, source, target, relation, strength, confidence, negated, valid_from, valid_until, batch).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.lineage import cut
from engram.config import DEFAULTS, Defaults
from engram.functions.scalars import edge_trust

#: Blocks of 64 seeds are broadcast up to this many.
BLOCKS = 10_000
ANTONYMS = (("1-URGENT", "5-LOW"), ("2-HIGH", "4-NOT SPECIFIED"))


def valid_at(t: int | Column | None, until: int | Column | None = None) -> Column:
    """Live edges (t null), or edges whose validity meets [t, until]; null starts are minus infinity."""
    if t is None:
        return F.col("valid_until").isNull()
    end = t if until is None else until
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_until").isNull() | (F.col("valid_until") > t))


def with_trust(edges: DataFrame, now_us: int, cfg: Defaults = DEFAULTS) -> DataFrame:
    return edges.withColumn("trust", edge_trust(F.col("strength"), F.col("confidence"), F.col("valid_from"), F.lit(now_us), cfg))


def relation_facts(edges: DataFrame, anchors: DataFrame, now_us: int, floor: float = 0.5, limit: int = 10) -> DataFrame:
    """(anchor, edge_id, trust, rank): an anchor's edges of the asked relation, strongest first, ``limit`` before the trust gate."""
    touched = edges.join(anchors, (F.col("source") == F.col("anchor")) & (F.col("relation") == F.col("asked")))
    order = Window.partitionBy("anchor").orderBy(F.desc("strength"), "edge_id")
    top = touched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return with_trust(top, now_us).where(F.col("trust") >= floor).select("anchor", "edge_id", F.round("trust", 6).alias("trust"), "rank")


def traverse(edges: DataFrame, seeds: DataFrame, now_us: int, depth: int = 3, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(seed, node, depth): nodes reached over live, positive edges in both directions.

    The first hop asks for trust of ``direct_trust``, later ones for strength of
    ``deep_trust``.  Seeds go by 64, as the bits of a long: a row is (block, node, bits), so what a task holds for a node is one row for 64
    seeds, and a hop joins once for all of them.  Each frontier is cut, so no hop is computed twice, and each hop is an equi-join that AQE may split.
    """
    live = with_trust(edges.where(valid_at(None) & ~F.col("negated")), now_us, cfg)
    kept = live.select("source", "target", "trust", "strength")
    both = kept.unionByName(kept.select(F.col("target").alias("source"), F.col("source").alias("target"), "trust", "strength"))
    direct = both.where(F.col("trust") >= cfg.direct_trust).select("source", "target").distinct()
    deep = cut(both.where(F.col("strength") >= cfg.deep_trust).select("source", "target").distinct())  # every later hop reads it
    # neighbours by number share a block; a partition's last block may have fewer
    numbered = cut(seeds.where("seed is not null").select("seed").distinct().orderBy("seed").withColumn("n", F.monotonically_increasing_id()))
    numbered = numbered.select("seed", F.shiftright("n", 6).alias("block"), (F.col("n") % 64).cast("int").alias("bit"))
    met = numbered.groupBy("block", F.col("seed").alias("node")).agg(F.bit_or(_bit()).alias("bits"))
    frontier = cut(met.withColumn("depth", F.lit(0)))
    seen = frontier.select("block", "node", F.col("bits").alias("seen"))
    walked = None
    for n in range(1, depth + 1):
        hop = direct if n == 1 else deep
        met = frontier.select("block", F.col("node").alias("source"), "bits").join(hop.where("target is not null"), "source")
        reached = met.groupBy("block", F.col("target").alias("node")).agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("block", "node").agg(F.bit_or("seen").alias("seen"))
        new = reached.join(known, ["block", "node"], "left").select("block", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))).alias("bits"))
        frontier = cut(new.where("bits <> 0").withColumn("depth", F.lit(n)))
        seen = seen.unionByName(frontier.select("block", "node", F.col("bits").alias("seen")))
        walked = frontier if walked is None else walked.unionByName(frontier)
    begun = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    if walked is None:
        return begun
    # a bit names its seed through the block's list, which has 64 at most; few blocks are broadcast, many are shuffled
    names = cut(numbered.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bit", "seed"))).alias("names")))
    names = F.broadcast(names) if names.count() <= BLOCKS else names
    bits = F.filter(F.array([F.lit(b) for b in range(64)]), lambda b: F.getbit(F.col("bits"), b) == 1)
    told = walked.join(names, "block").select(F.explode(F.transform(bits, lambda b: F.col("names")[b])).alias("seed"), "node", "depth")
    return begun.unionByName(told)


def _bit() -> Column:
    """The long whose one set bit is ``bit``."""
    return F.expr("shiftleft(1L, bit)")


def entity_timeline(edges: DataFrame, t0: int, t1: int, last: int = 8) -> DataFrame:
    """(source, relation, lines): transitions that meet the window, oldest to newest, the last eight."""
    met = edges.where(valid_at(t0, t1))
    newest = Window.partitionBy("source", "relation").orderBy(F.desc("valid_from"), F.desc("edge_id"))
    kept = met.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= last)
    line = F.concat_ws(" ", F.col("valid_from").cast("string"), F.col("target").cast("string"), F.when(F.col("negated"), "-").otherwise("+"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "edge_id", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("source", "relation").agg(F.array_join(lines, "; ").alias("lines"), F.count("*").alias("n"))


def entity_diff(edges: DataFrame, t0: int, t1: int) -> DataFrame:
    """(edge_id, kind): added or retracted in [t0, t1) by start, expired by end; one pass over the edges."""
    started = (F.col("valid_from") >= t0) & (F.col("valid_from") < t1)
    ended = (F.col("valid_until") >= t0) & (F.col("valid_until") < t1)
    kinds = F.array_compact(F.array(F.when(started, F.when(F.col("negated"), "retracted").otherwise("added")), F.when(ended, F.lit("expired"))))
    return edges.where(started | ended).select("edge_id", F.explode(kinds).alias("kind"))


def contradictions(edges: DataFrame) -> DataFrame:
    """(source, target, relation, winner): live positive and negative edges of one key; the newer wins, on ties the negation.

    Grouped, not self-joined: a hot key costs one row for each partial group.
    """
    live = edges.where(valid_at(None))
    newest = lambda flag: F.max(F.when(flag, F.col("valid_from")))
    both = live.groupBy("source", "target", "relation").agg(newest(~F.col("negated")).alias("yes"), newest(F.col("negated")).alias("no"))
    return both.where("yes is not null and no is not null").select("source", "target", "relation", F.when(F.col("yes") > F.col("no"), "positive").otherwise("negation").alias("winner"))


def antonym_conflicts(edges: DataFrame, pairs=ANTONYMS) -> DataFrame:
    """(source, target, first, second): live positive edges of one pair with opposite relations; one grouping for all pairs."""
    known = F.create_map(*[F.lit(x) for n, (a, b) in enumerate(pairs) for x in (a, n, b, n)])
    live = edges.where(valid_at(None) & ~F.col("negated")).withColumn("pair", F.try_element_at(known, F.col("relation"))).where("pair is not null")
    sides = live.groupBy("source", "target", "pair").agg(F.min("relation").alias("first"), F.max("relation").alias("second"))
    return sides.where("first <> second").select("source", "target", "first", "second")


def pile_up(edges: DataFrame, pending: Column, many_pending: int = 3, many_active: int = 2) -> DataFrame:
    """(source, n_pending, n_active): entities with many pending and many active targets."""
    live = edges.where(valid_at(None)).withColumn("p", pending)
    counts = live.groupBy("source").agg(
        F.count_distinct(F.when(F.col("p"), F.col("target"))).alias("n_pending"), F.count_distinct(F.when(~F.col("p"), F.col("target"))).alias("n_active")
    )
    return counts.where((F.col("n_pending") > many_pending) & (F.col("n_active") > many_active))


def duplicate_names(entities: DataFrame) -> DataFrame:
    """(name, first, others): entities that share a name, as a group; members are not expanded into pairs."""
    groups = entities.groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return groups.where("n > 1")


def denied_entities(events: DataFrame, denied: Column) -> DataFrame:
    """Entities all of whose events come from denied batches; an event without a batch keeps its entity."""
    flag = F.coalesce(denied, F.lit(False)) & F.col("batch").isNotNull()
    return events.groupBy("entity").agg(F.bool_and(flag).alias("all_denied")).where("all_denied").select("entity")


def compact(events: DataFrame, at_least: int = 100) -> DataFrame:
    """(entity, facts): the facts of entities with many events, replayed in order: the last event of a signature decides."""
    big = events.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("entity")
    last = events.join(big, "entity").groupBy("entity", "relation", "target").agg(F.max_by("kind", F.struct("us", "event_id")).alias("kind"))
    return last.groupBy("entity").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "add", F.concat_ws(":", "relation", "target")))), ",").alias("facts"),
        F.count("*").alias("signatures"),
    )


def decay_edges(edges: DataFrame, cycles: int, cfg: Defaults = DEFAULTS) -> DataFrame:
    """(edge_id, strength, action): closed-form decay; active edges are demoted, weak pending ones expire."""
    rate = cfg.edge_decay_daily ** (1 / cfg.decay_cycles_per_day)
    new = F.round(F.col("strength") * F.pow(F.lit(rate), F.lit(cycles)), 6)
    live = edges.where(valid_at(None)).withColumn("strength", new)
    return live.select("edge_id", "strength", F.when(F.col("strength") < cfg.edge_expiry, "expire").when(F.col("strength") < cfg.edge_demotion, "demote").otherwise("keep").alias("action"))


def notes(edges: DataFrame, top: int = 20) -> DataFrame:
    """(source, links): each entity's strongest live links in order."""
    order = Window.partitionBy("source").orderBy(F.desc("strength"), "edge_id")
    kept = edges.where(valid_at(None) & ~F.col("negated")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)
    parts = F.array_sort(F.collect_list(F.struct("nth", F.concat_ws("->", "relation", "target").alias("x"))))
    return kept.groupBy("source").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "|").alias("links"))


def merge_entities(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Live edges after entities were merged: repointed, self-loops dropped, doubles joined (largest strength and confidence, earliest start)."""
    live = edges.where(valid_at(None))
    out = live
    for side in ("source", "target"):
        out = out.join(remap.select(F.col("old").alias(side), F.col("new").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return out.where("source <> target").groupBy("source", "target", "relation", "negated").agg(
        F.max("strength").alias("strength"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from")
    )


#: Characters of a source that are parsed at once, as far as its statements allow, and symbols of a frame.
PARSED, SYMBOLS = 1 << 18, 100_000
_LINE = re.compile(r"\r\n|\r|\n")
_OPENS = re.compile(r"(?:class|def|async)\b|@")


def parsed_parts(text: str, size: int) -> Iterator[tuple[int, ast.Module]]:
    """(lines before, syntax tree) of the parts of a source; the parts together are the source.

    A part ends before a line that opens a class or function at the left margin, if what stands before parses by itself: such a line
    continues no statement but one that is open, and an open one doesn't parse.  Else the part is made twice as long.
    """
    at = lines = 0
    while at < len(text):
        want, end = size, at
        while True:
            end, want = _margin(text, max(end, at + want)), want * 2
            part = text[at:end]
            try:
                tree = ast.parse(part)
                break
            except SyntaxError:
                if end == len(text):
                    raise
        yield lines, tree
        lines += len(_LINE.findall(part))
        at = end


def _margin(text: str, at: int) -> int:
    for found in _LINE.finditer(text, at):
        if _OPENS.match(text, found.end()):
            return found.end()
    return len(text)


def symbols_of(path: str, text: str, size: int = PARSED) -> list[tuple[str, str, str, int]]:
    """(path, symbol, kind, line) of one source."""
    module = path.removesuffix(".py").replace("/", ".")
    out = [(path, module, "module", 1)]
    try:
        for lines, tree in parsed_parts(text, size):
            stack = [(module, n) for n in tree.body]
            while stack:
                at, node = stack.pop()
                if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    name = f"{at}.{node.name}"
                    out.append((path, name, "class" if isinstance(node, ast.ClassDef) else "function", lines + node.lineno))
                    stack += [(name, n) for n in node.body]
    except (SyntaxError, ValueError):
        return out[:1]
    return out


def code_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol, kind, line) of Python sources (path, text): modules, classes and functions by the parser; broken files give their module only.

    A source is parsed in parts, so a task holds the tree of a part and not that of a whole source.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                found = symbols_of(path, text)
                for at in range(0, len(found), SYMBOLS):
                    yield pd.DataFrame(found[at : at + SYMBOLS], columns=["path", "symbol", "kind", "line"])

    return files.select("path", "text").mapInPandas(walk, "path string, symbol string, kind string, line int")
