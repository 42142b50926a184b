"""Clusters that have come close are merged, and mentions are matched to entities without using one twice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.vectors import block_topk
from engram.lineage import cut
from engram.operators.similar import BROADCAST_ROWS, counted, matrix, near_pairs, spread

#: Rows of a block, if they have 64 components or fewer; less of longer ones.
BLOCK_ROWS = 32_768
RAW, ADJUSTED, BONUS_EACH, BONUS_MOST = 0.82, 0.90, 0.04, 0.12
MATCH_FLOOR = 0.85


class _Names:
    """How many names two rows share: each row's distinct names as sorted numbers."""

    def __init__(self, casts: pa.ChunkedArray):
        flat = [pc.list_flatten(x) for x in casts.chunks]
        of = np.concatenate([pc.list_parent_indices(x).to_numpy() + n for x, n in zip(casts.chunks, np.cumsum([0] + [len(x) for x in casts.chunks]).tolist(), strict=False)])
        coded = pc.dictionary_encode(pa.chunked_array(flat, flat[0].type).combine_chunks(), null_encoding="encode")
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.kinds = max(1, len(coded.dictionary))
        met = np.sort(of.astype(np.int64) * self.kinds + coded.indices.to_numpy())
        self.met = met[np.diff(met, prepend=-1) > 0]
        self.held = np.bincount(self.met // self.kinds, minlength=len(casts))
        self.start = np.cumsum(self.held) - self.held

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        few = self.held[a] <= self.held[b]
        a, b = np.where(few, a, b), np.where(few, b, a)
        pair = np.repeat(np.arange(len(a)), self.held[a])
        if not len(pair):
            return np.zeros(len(a), np.int64)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(self.held[a]) - self.held[a], self.held[a])
        wanted = b[pair] * self.kinds + self.met[self.start[a][pair] + nth] % self.kinds
        at = np.minimum(np.searchsorted(self.met, wanted), len(self.met) - 1)
        return np.bincount(pair[self.met[at] == wanted], minlength=len(a))


def _absorbers(live: DataFrame, first: bool, raw: float, adjusted: float, bonus_each: float, bonus_most: float, block_rows: int) -> DataFrame:
    """(id, age, into): for each cluster the oldest older one of its group that would absorb it, of the pairs that hold one that ``asks``.

    A group is dealt into blocks and every two of them meet in one task, which gives one row a newer
    cluster at most, so a large group is shared by many tasks.  Where all of them ask (the ``first`` time), two blocks meet once;
    later on the blocks of those that ask, which are few, meet all blocks.
    """
    blocks = lambda n: F.ceil(n * F.greatest(F.max(F.size("sums")), F.lit(64)) / (64 * block_rows)).cast("int")
    sizes = live.groupBy(F.col("group").alias("of")).agg(blocks(F.count("*")).alias("blocks"), blocks(F.count_if("asks")).alias("asking"), F.count("*").alias("held"))
    sizes = counted(sizes.where("held > 1 and asking > 0").drop("held"))
    size = F.sqrt(F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x))
    rows = live.where(size > 0).join(sizes, F.col("group") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda x, y, left, right: F.struct(x.alias("x"), y.alias("y"), left.alias("left"), right.alias("right"))
    own, yes, no = F.col("block"), F.lit(True), F.lit(False)
    if first:
        places = F.transform(every("blocks"), lambda o: place(F.least(own, o), F.greatest(own, o), own <= o, own >= o))
    else:
        met = F.transform(every("asking"), lambda x: place(x, own, no, yes))
        asked = F.transform(every("blocks"), lambda y: place(F.pmod(F.xxhash64("id"), F.col("asking")).cast("int"), y, yes, no))
        places = F.when(F.col("asks"), F.concat(met, asked)).otherwise(met)
    dealt = rows.select("group", "id", "age", "sums", "cast", F.inline(places))

    def product(table: pa.Table) -> pa.Table:
        ids, ages = table["id"].to_numpy(), table["age"].to_numpy()
        order = np.lexsort((ids, ages))
        names = _Names(table["cast"])
        m = matrix(table["sums"])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        left, right = (order[table[c].to_numpy()[order]] for c in ("left", "right"))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        into = np.full(len(order), len(order))  # by rank: oldest first
        for i, j, cosine in near_pairs(m[left], m[right], raw, len(left) == len(right) == len(order)):
            a, b = left[i], right[j]
            good = (cosine + bonus_most >= adjusted) & (ids[a] != ids[b])
            a, b, cosine = a[good], b[good], cosine[good]
            good = cosine >= adjusted
            unsure = np.flatnonzero(~good)
            good[unsure] = cosine[unsure] + np.minimum(bonus_most, bonus_each * names.shared(a[unsure], b[unsure])) >= adjusted
            a, b = rank[a[good]], rank[b[good]]
            np.minimum.at(into, np.maximum(a, b), np.minimum(a, b))
        newer = np.flatnonzero(into < len(order))
        older = order[into[newer]]
        return pa.table({"id": ids[order[newer]], "age": ages[older], "into": ids[older]})

    dealt = spread(dealt, "group", "x", "y") if first else dealt
    return dealt.groupBy("group", "x", "y").applyInArrow(product, "id long, age long, into long")


def merge_clusters(
    clusters: DataFrame, raw: float = RAW, adjusted: float = ADJUSTED, bonus_each: float = BONUS_EACH, bonus_most: float = BONUS_MOST, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, into) of clusters (group, id, age, n, vector, cast): the cluster each one ends in, itself if it stays.

    In rounds, until nothing moves: a cluster goes to the oldest older one of its group whose centroid is near enough
    (cosine ``raw``, and ``adjusted`` with a bonus for shared recurring names), if that one
    stays itself in this round; then centroids are the means of all members and casts their union.  Ids are unique.
    A null or zero vector, or one of another length than its group's oldest, takes no part.

    All clusters ask in the first round.  Later only those ask that took others, or whose choice has gone; what
    the others would choose is known, but for those that took others.
    """
    rows = clusters.where("vector is not null").select(
        F.coalesce(F.col("group").cast("string"), F.lit("\0")).alias("group"), F.col("id").cast("long"), F.col("age").cast("long"), "n", F.coalesce("cast", F.array().cast("array<string>")).alias("cast"),
        F.transform("vector", lambda x: x.cast("double") * F.col("n")).alias("sums"), F.lit(True).alias("asks"),
    )
    width = counted(rows.groupBy(F.col("group").alias("of")).agg(F.min_by(F.size("sums"), F.struct("age", "id")).alias("width")))
    usable = rows.join(width, F.col("group") == F.col("of")).where(F.size("sums") == F.col("width")).drop("of", "width")
    live, moved, known = cut(usable), None, None
    while True:
        found = _absorbers(live, known is None, raw, adjusted, bonus_each, bonus_most, block_rows)
        found = found if known is None else found.unionByName(known)
        wants = cut(found.groupBy("id").agg(F.min(F.struct("age", "into")).alias("x")).select("id", "x.age", "x.into"))
        held = wants.count()
        if not held:
            break
        few = F.broadcast if held <= BROADCAST_ROWS else lambda df: df
        # who wants to go does not take others in this round; the oldest of a chain always stays, so every round moves some
        goes = cut(wants.join(few(wants.select(F.col("id").alias("into"))), "into", "left_anti").select("id", "into"))
        moved = goes if moved is None else cut(
            moved.join(few(goes.select(F.col("id").alias("into"), F.col("into").alias("on"))), "into", "left").select("id", F.coalesce("on", "into").alias("into")).unionByName(goes)
        )
        gone = few(goes.select(F.col("id").alias("into")))
        stay = wants.join(few(goes.select("id")), "id", "left_anti")
        known = cut(stay.join(gone, "into", "left_anti").select("id", "age", "into"))
        lost = stay.join(gone, "into", "left_semi").select("id", F.lit(None).cast("long").alias("own"))
        takers = goes.select(F.col("into").alias("id"), F.col("into").alias("own")).distinct()
        fate = few(cut(goes.select("id", F.col("into").alias("own")).unionByName(takers).unionByName(lost).select(F.col("id").alias("of"), "own")))
        placed = live.join(fate, F.col("id") == F.col("of"), "left")
        rest = placed.where("own is null").withColumn("asks", F.col("of").isNotNull()).select("group", "id", "age", "n", "cast", "sums", "asks")
        placed = placed.where("own is not null")
        at = placed.select("own", F.posexplode("sums").alias("at", "x")).groupBy("own", "at").agg(F.sum("x").alias("x"))
        sums = at.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s")).select("own", F.transform("s", lambda s: s["x"]).alias("sums"))
        heads = placed.groupBy("own").agg(F.min(F.struct("age", "id", "group")).alias("h"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("cast"))).alias("cast"))
        took = heads.join(sums, "own").select("h.group", F.col("own").alias("id"), "h.age", "n", "cast", "sums", F.lit(True).alias("asks"))
        live = cut(rest.unionByName(took))
    ids = clusters.select(F.col("id").cast("long"))
    return ids.select("id", F.col("id").alias("into")) if moved is None else ids.join(moved, "id", "left").select("id", F.coalesce("into", "id").alias("into"))


def match_mentions(mentions: DataFrame, entities: DataFrame, floor: float = MATCH_FLOOR) -> DataFrame:
    """(prompt, nth, entity, score) of mentions (prompt, nth, name, vector) against entities (id, names, vector).

    In the order of ``nth`` each mention of a prompt takes the nearest entity (dot product of at least ``floor``) that no
    mention before it has taken, or else the first entity of its name or alias, if that is free; a mention
    that gets none is left out, and the score of a name is null.

    The n-th mention of a prompt needs its n nearest at most, since n - 1 are taken; so the
    search keeps as many as the largest prompt has mentions, and a fold over the prompt's few mentions decides.
    """
    order = Window.partitionBy("prompt").orderBy("nth")
    placed = cut(mentions.withColumn("place", F.row_number().over(order)).withColumn("mention", F.xxhash64("prompt", "place")))
    most = placed.agg(F.max("place")).first()[0] or 1
    near = block_topk(entities, placed.select(F.col("mention").alias("query_id"), "vector"), most, "id", "vector", digits=9).where(F.col("score") >= floor)
    near = near.groupBy(F.col("query_id").alias("mention")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    named = entities.select("id", F.explode(F.transform("names", lambda x: F.lower(F.trim(x)))).alias("key")).groupBy("key").agg(F.min("id").alias("named"))
    asked = placed.withColumn("key", F.lower(F.trim("name"))).join(near, "mention", "left").join(named, "key", "left")
    asked = asked.groupBy("prompt").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "near", "named"))).alias("m"))
    made = "array<struct<nth:bigint,entity:bigint,score:double>>"
    start = F.array().cast(made)

    def take(done, m):
        taken = F.transform(done, lambda x: x["entity"])
        free = F.filter(F.coalesce(m["near"], F.array().cast("array<struct<rank:int,id:bigint,score:double>>")), lambda x: ~F.array_contains(taken, x["id"]))
        first = F.get(free, F.lit(0))
        by_name = m["named"].isNotNull() & ~F.array_contains(taken, F.coalesce(m["named"], F.lit(0)))
        nth = m["nth"].cast("long").alias("nth")
        found = F.when(F.size(free) > 0, F.array(F.struct(nth, first["id"].alias("entity"), first["score"].alias("score")))).when(
            by_name, F.array(F.struct(nth, m["named"].alias("entity"), F.lit(None).cast("double").alias("score")))
        ).otherwise(start)
        return F.concat(done, found.cast(made))

    return asked.select("prompt", F.inline(F.aggregate("m", start, take)))
