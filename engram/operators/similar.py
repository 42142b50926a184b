"""Exact similarity within groups: links, their components, and no pairs in the output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.lineage import cut

BLOCK_ROWS = 1024
#: Rows of a side of one product, and pairs that are handed on at once.
TILE, PAIRS = 1024, 1 << 18
#: Rows that may be broadcast, if they were counted.
BROADCAST_ROWS = 1_000_000


def counted(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if there are few of them."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to all shuffle partitions: what is done with a few rows can take long, so small partitions are not put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks if len(x)]
    return np.concatenate(flat).reshape(len(column), -1)


def near_pairs(left: np.ndarray, right: np.ndarray, floor: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the rows of two blocks of unit vectors with a cosine of at least ``floor``, some at a time; i < j if it is the ``same`` block.

    Single precision tells what may be near; cosines are made in double precision and rounded to 9 digits.
    """
    a, b, least = left.astype(np.float32), right.astype(np.float32), np.float32(floor - (left.shape[1] + 16) * 2.0**-23)
    held, n = [], 0
    for x in range(0, len(a), TILE):
        for y in range(x if same else 0, len(b), TILE):
            maybe = a[x : x + TILE] @ b[y : y + TILE].T >= least
            at = np.flatnonzero(maybe)
            if not len(at):
                continue
            i, j = np.divmod(at, maybe.shape[1])
            if same and x == y:
                i, j = i[i < j], j[i < j]
            if len(i) * 8 > maybe.size:
                cosine = (left[x : x + TILE] @ right[y : y + TILE].T)[i, j]
            else:
                cosine = np.einsum("ij,ij->i", left[x + i], right[y + j])
            cosine = np.round(cosine, 9)
            good = cosine >= floor
            held.append((x + i[good], y + j[good], cosine[good]))
            n += len(held[-1][0])
            if n >= PAIRS:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def joining(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``label`` of each place after the pairs (a, b) have joined theirs, and as many of the pairs as it takes."""
    kept_a, kept_b = [a[:0]], [b[:0]]
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return label, np.concatenate(kept_a), np.concatenate(kept_b)
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        tops, first = np.unique(high, return_index=True)  # a label goes below one other at most, a smaller one, so nothing goes round
        kept_a.append(a[first])
        kept_b.append(b[first])
        below = np.arange(len(label))
        below[tops] = low[first]
        while (below[below] != below).any():
            below = below[below]
        label = below[label]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) that is not the least of its component: large and small stars in turn until nothing moves."""
    edges = cut(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())

    before = mark(edges)
    while before[0]:
        sides = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = sides.groupBy("high").agg(F.min("low").alias("m")).select("high", F.least("high", "m").alias("m"))
        large = sides.join(least, "high").where("low > high").select(F.col("low").alias("high"), F.col("m").alias("low"))
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        both = F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct("high", F.col("m").alias("low")))
        edges = cut(large.join(least, "high").select(F.inline(both)).where("high <> low").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """As many of the pairs (of places) as it takes to join what they join."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def linked_groups(rows: DataFrame, threshold: float, normalise: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, id, links, component) of rows (group, id, vector): how many rows of its group a row is similar to, and the least id it reaches.

    A group is dealt into blocks by a hash of the id, and every two of its blocks meet in one
    matrix product, so a hot group is shared by many tasks.  A product emits the count of each
    row's links and the few links that join its rows, never its pairs.
    """
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    own = rows.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", "id", F.col("vector").cast("array<double>").alias("vector"), "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def product(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        m, ids = np.stack(frame["vector"].map(np.asarray)), frame["id"].to_numpy()
        if normalise:
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        near = np.triu(m @ m.T >= threshold, 1)
        if frame["x"].iloc[0] != frame["y"].iloc[0]:  # pairs inside a block belong to the block's own product
            side = frame["block"].to_numpy()
            near &= side[:, None] != side[None, :]
        counts = near.sum(0) + near.sum(1)
        joins = np.array(_forest(np.argwhere(near)), np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "group": [key[0]] * (len(some) + len(joins)), "a": np.concatenate((ids[some], ids[joins[:, 0]])), "b": pd.array([None] * len(some) + ids[joins[:, 1]].tolist(), "Int64"),
            "n": np.concatenate((counts[some], np.zeros(len(joins), np.int64))),
        })

    kind = rows.schema["group"].dataType.simpleString()
    found = cut(dealt.groupBy("group", "x", "y").applyInPandas(product, f"group {kind}, a long, b long, n long"))
    # an id stands for a row of its group only
    counts = found.where("b is null").groupBy("group", F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    node = lambda side: F.struct("group", F.col(side).alias("id")).alias(side)
    roots = components(found.where("b is not null").select(node("a"), node("b"))).select("node.group", "node.id", F.col("root.id").alias("root"))
    named = rows.select("group", "id").join(counts, ["group", "id"], "left").join(roots, ["group", "id"], "left")
    return named.select("group", "id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("root", "id").alias("component"))
