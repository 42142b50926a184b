"""Exact top-k inner-product search.

Tiled matrix products: queries are packed into tiles, and the tasks that read the
vectors pack them into shards; every (tile, shard) pair is one matrix product.  What
reaches a query's k-th best score so far is selected from the product and merged into
the task's lists.  The lists of the tasks are the leaves of a tree: ``FAN_IN`` lists of a
query at a time are merged into one, level by level, so that no step holds more
than ``FAN_IN * k`` rows of a query, whatever the number of tasks.

Queries travel to the shards, so no vector is ever shuffled: a pass broadcasts tiles
of ``PASS_BYTES`` at most, whatever the number of queries, and reads the vectors once.
Tasks are no more than ``TASKS`` times the shuffle partitions, which bounds the leaves.

Defined results
---------------
* Components are quantised to ``floor(scale * x)`` in double precision, so all
  products of ordinary vectors are exact integers.
* A vector that is null, or holds a null, NaN or infinite component, takes no
  part, neither as query nor as candidate.  An empty vector has no components;
  it takes part and scores 0 against other empty vectors.
* Only vectors of equal length are compared.
* A repeated query id is searched once, with its smallest vector.
* Rows with a query's own ``vec_id`` (repeats included) are not its candidates;
  repeated candidate rows are separate candidates.  Ties go to the smaller id.
* Null ids take no part.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import cut, ensure_checkpoint_dir, give_back, parallelism, table

SHARD_ROWS = 2048
TILE_ROWS = 1024
#: Bytes of the queries that a pass broadcasts, and tasks of a pass for each shuffle partition.
PASS_BYTES, TASKS = 32 << 20, 2
#: Lists of a query that meet in one step of the tree.
FAN_IN = 8


class Best:
    """The k best candidates so far of the queries of a tile, by (score descending, id ascending)."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def merge(self, ids: np.ndarray, shard: np.ndarray) -> None:
        """Take in a shard: one product, a partial selection, and a sort of what is selected."""
        product = self.matrix @ shard.T
        if len(ids) > self.k:  # nothing below the shard's own k-th best can be among the best; one place more for the query itself
            at = len(ids) - min(len(ids), self.k + int(np.unique(ids, return_counts=True)[1].max()))
            bound = np.maximum(self.least, np.partition(product, at, axis=1)[:, at])
        else:
            bound = self.least
        row, column = np.nonzero(product >= bound[:, None])
        own = ids[column] != self.ids[row]
        row, column = row[own], column[own]
        rows, found = np.concatenate((self.rows, row)), np.concatenate((self.found, ids[column]))
        scores = np.concatenate((self.scores, product[row, column]))
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.rows, self.found, self.scores = rows[keep], found[keep], scores[keep]
        last = place[keep] == self.k - 1
        self.least[self.rows[last]] = self.scores[last]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.rows], "vec_id": self.found, "score": self.scores.astype("i8")})


def _by_length(frame: pd.DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most ``rows`` vectors of one length each."""
    lengths = frame["q"].map(len).to_numpy()
    for length in np.unique(lengths):
        part = frame[lengths == length]
        for at in range(0, len(part), rows):
            block = part.iloc[at : at + rows]
            yield block["vec_id"].to_numpy(np.int64), np.array(block["q"].tolist(), "f8").reshape(len(block), length)


def exact_topk(
    vectors: DataFrame, k: int = 5, query_modulus: int = 50, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", pass_bytes: int = PASS_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's k best candidates."""
    spark = vectors.sparkSession
    scaled = lambda x: x * F.lit(float(scale))
    # doubles from 2**53 on are whole already
    floor = lambda x: F.when(F.abs(scaled(x)) < F.lit(2.0**53), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    quantised = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))))
        .select("vec_id", F.transform("v", floor).alias("q"))
    )
    # every pass reads the queries
    queries = cut(quantised.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).groupBy("vec_id").agg(F.min("q").alias("q")))
    size = queries.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    tasks = quantised.coalesce(TASKS * parallelism(spark))

    def searched(turn: int) -> DataFrame:
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn).toPandas()
        shipped = spark.sparkContext.broadcast(list(_by_length(own, TILE_ROWS)))

        def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tiles = [Best(ids, matrix, k) for ids, matrix in shipped.value]
            for frame in frames:
                for ids, shard in _by_length(frame, SHARD_ROWS):
                    for tile in tiles:
                        if tile.matrix.shape[1] == shard.shape[1]:
                            tile.merge(ids, shard)
            leaf = TaskContext.get().partitionId()
            for tile in tiles:
                yield tile.frame().assign(node=leaf)
            give_back()

        return tasks.mapInPandas(products, "query_id long, vec_id long, score long, node int")

    if passes == 1:
        partial = searched(0)
    else:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/topk-{uuid.uuid4().hex}"
        for turn in range(passes):
            searched(turn).write.mode("append").parquet(folder)
        partial = spark.read.parquet(folder)
    return merged(partial, k, TASKS * parallelism(spark), fan_in)


def merged(lists: DataFrame, k: int, nodes: int, fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): the lists (query_id, vec_id, score, node) of all nodes, ``fan_in`` at a time, until one is left."""
    while True:
        nodes = -(-nodes // fan_in)
        parent = lists.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        order = Window.partitionBy("query_id", "node").orderBy(F.desc("score"), F.asc("vec_id"))
        lists = parent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
