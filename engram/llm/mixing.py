"""Mixing sources to target weights by the cube method.

Sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and
share the total number of words; a source's target stops at ``repeat_cap``
times its size and the excess is shared again by weight.  The rate of a source
is target / size: each of its documents is taken ``floor(rate)`` times, and once
more with the fractional part as inclusion probability.

Which documents get the extra copy is decided by the cube method.  The flight
moves the inclusion probabilities of open units along the null space of the
balancing constraints (number of documents, number of words): the largest open
unit moves by one, all others together make up for its words and its place, and
the step goes, by a fair draw, until one of them is 0 or 1.  So larger documents are
decided first, while there are others to make up for them, and probabilities keep
their expectation.  The flight runs in blocks of a source, then on what the blocks
leave over, level by level, until at most two small units of a source remain open.
The landing takes the subset of these two with the least error in words; no unit that
the flight has decided is decided again, so all others keep their probabilities.

Very long documents (a share of a block's words each) fly and land before all others:
the words that they take too many or too few are shared by all other documents of the
source, whose probabilities move by one amount, so that no block makes up for them alone.

A hot source is split over many blocks, and reruns agree: blocks depend on
a hash of the rows, not on how the table is stored.

Defined results
---------------
* A null or wordless text has size 0, takes 0 words and no part in the flight.
* A source without words has target 0.  Null is a source of its own.
* Repeated rows are units of their own; fully equal rows are interchangeable.
* Extra columns are ignored.  An empty table gives no rows.
* One row a source (not a document) meets in one task, to share the targets.
"""

from __future__ import annotations

import math
import random
import zlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import WORD_PATTERN, cut, table

WEIGHTS = (1, 2, 3)
REPEAT_CAP = 3
BLOCK_ROWS = 4096
#: Blocks whose leftovers meet in one block of the next level (at most two rows each).
FAN_IN = 1024
BROADCAST_SOURCES = 10_000
#: A document of more than one in LONG_SHARE of the words of a block is decided before all others.
LONG_SHARE = 16
TINY = 1e-9
#: Copies of one row that a task writes out at once.
COPY_RUN = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = REPEAT_CAP) -> DataFrame:
    """(source, source_size, units, target) of every source in ``sizes`` (source, size).

    Sources stop at their cap in the order of cap / weight, so the shared rate
    is the first that leaves the next source below its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double")
    by_cap = Window.orderBy("fills", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * cap)
        .withColumn("fills", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "nth", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "units", "target")
    )


def flight(chances: list[float], sizes: list[float], seed: int) -> list[float]:
    """Cube flight: probabilities with all but at most two of them moved to 0 or 1, their sum and that of words kept."""
    draw = random.Random(seed).random
    c, s = np.array(chances, float), np.array(sizes, float)
    s /= max(1.0, s.max(initial=0.0))
    c[c < TINY], c[c > 1 - TINY] = 0.0, 1.0
    live = np.argsort(-s, kind="stable")
    live = live[(c[live] > 0) & (c[live] < 1)]
    while len(live) > 1:
        lead, rest = live[0], live[1:]
        p, z = c[rest], s[rest]
        w = p * (1 - p)
        n = w.sum()
        middle = w @ z / n
        spread = w @ (z - middle) ** 2
        if spread > n * 1e-15:
            way = w * ((middle - s[lead]) / spread * (z - middle) - 1 / n)
        elif abs(s[lead] - middle) < 1e-9:
            way = w * (-1 / n)
        else:  # units of one size cannot make up for another size: the lead stays open
            live = rest
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            to_one, to_zero = (1 - p) / np.abs(way), p / np.abs(way)
        up = min(1 - c[lead], np.where(way > 0, to_one, to_zero).min())
        down = min(c[lead], np.where(way > 0, to_zero, to_one).min())
        step = up if draw() * (up + down) < down else -down
        c[lead] += step
        c[rest] += step * way
        moved = c[live]
        moved[moved < TINY], moved[moved > 1 - TINY] = 0.0, 1.0
        c[live] = moved
        live = live[(moved > 0) & (moved < 1)]
    return c.tolist()


def landing(chances: list[float], sizes: list[float]) -> list[float]:
    """Decide the at most two units that a flight leaves open: the subset with the least error in words, then in documents."""
    out = list(chances)
    at = [n for n, c in enumerate(chances) if 0 < c < 1]
    words, count = sum(chances[n] * sizes[n] for n in at), sum(chances[n] for n in at)
    error = {x: (abs(sum(v * sizes[n] for v, n in zip(x, at, strict=True)) - words), abs(sum(x) - count), x) for x in product((0.0, 1.0), repeat=len(at))}
    for value, n in zip(min(error, key=error.get), at, strict=True):
        out[n] = value
    return out


def numbered_copies(rows: DataFrame, run: int = COPY_RUN) -> DataFrame:
    """``rows`` with ``copy``, from 0 among equal rows, so that equal rows are dealt over blocks as others are.

    Equal rows are counted (within tasks first) and written out again; one with very many copies is written out by several tasks.
    """
    counted = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))).alias("nth"))
    if (counted.agg(F.max("copies")).first()[0] or 0) > run:
        runs = runs.repartition(*rows.columns, "nth")
    first, last = F.col("nth") * run, F.least(F.col("copies"), (F.col("nth") + 1) * run) - 1
    return runs.select(*rows.columns, F.explode(F.sequence(first, last)).alias("copy"))


UNIT_COLUMNS = "doc_id long, source string, size long, source_size long, target double, blocks long, place long, chance double"


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = REPEAT_CAP, block_rows: int = BLOCK_ROWS, seed: int = 8, fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs`` (doc_id, text, source)."""
    sizes = cut(numbered_copies(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"))))
    targets = cut(source_targets(sizes, weights, cap))
    shape = targets.agg(F.count("*"), F.max("units")).first()
    if shape[0] <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sizes.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(
            "s.doc_id", "s.source", "s.size", "t.source_size", "t.target",
            F.greatest(F.lit(1), F.ceil(F.col("t.units") / block_rows)).cast("long").alias("blocks"),
            F.when(F.col("s.copy") == 0, F.xxhash64("s.doc_id", "s.size", F.lit(seed))).otherwise(F.xxhash64("s.doc_id", "s.size", F.lit(seed), "s.copy")).alias("place"),
            F.least(F.lit(float(cap)), rate).alias("rate"),
        )
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("long"))
        .withColumn("chance", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0)))
        .drop("rate")
    )

    schema = UNIT_COLUMNS.replace("chance", "whole long, chance")
    names = [c.split()[0] for c in schema.split(", ")]

    def fly(level: int, stage: str):
        def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["size", "place", "doc_id"], ascending=[False, True, True], kind="stable")
            sizes_, start = frame["size"].astype(float).tolist(), zlib.crc32(repr((seed, level, stage, key)).encode())
            moved = flight(frame["chance"].tolist(), sizes_, start)
            # a source lands where it meets in one block, however many the others have
            lands = frame["blocks"].iloc[0] <= fan_in**level
            frame["chance"] = landing(moved, sizes_) if lands else moved
            return frame.drop(columns="block")

        return block

    def flown(left: DataFrame, stage: str) -> DataFrame:
        done, level, most = None, 0, max(1, math.ceil((shape[1] or 0) / block_rows))
        while True:
            block = F.floor(F.pmod(F.col("place"), F.col("blocks")) / fan_in**level).cast("long")
            moved = left.select(*names, block.alias("block")).groupBy("source", "block").applyInPandas(fly(level, stage), schema).select(names)
            if most == 1:
                return moved if done is None else done.unionByName(moved)
            moved = cut(moved)
            decided = moved.where("chance <= 0 or chance >= 1")
            done = decided if done is None else done.unionByName(decided)
            left, level, most = moved.where("chance > 0 and chance < 1"), level + 1, math.ceil(most / fan_in)

    is_long = F.col("size") * F.col("blocks") * LONG_SHARE > F.col("source_size")
    is_open = (F.col("chance") > TINY) & (F.col("chance") < 1 - TINY)
    rest, first = units, units.where(is_long & is_open)
    if not first.isEmpty():
        first = cut(flown(first, "long"))
        rest = units.where(~(is_long & is_open))
        rate_ = F.col("target") / F.col("source_size")
        excess = (
            first.groupBy("source")
            .agg(F.sum(F.col("size") * (F.col("chance") - (rate_ - F.floor(rate_)))).alias("words"))
            .join(rest.where(is_open).groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("others")), F.col("source").eqNullSafe(F.col("of")))
            .select("of", (F.col("words") / F.col("others")).alias("shift"))
        )
        excess = cut(excess)
        excess = F.broadcast(excess) if shape[0] <= BROADCAST_SOURCES else excess
        moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("chance") - F.coalesce("shift", F.lit(0.0))))
        rest = rest.join(excess, F.col("source").eqNullSafe(F.col("of")), "left")
        rest = rest.select(*[c for c in names if c != "chance"], F.when(is_open, moved).otherwise(F.col("chance")).alias("chance"))
    done = flown(rest, "all")
    if rest is not units:
        done = done.unionByName(first)
    return done.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("chance").cast("long")).alias("copies")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
