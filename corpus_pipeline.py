"""The training-data pipeline: toxicity filter, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import mixing, neardup, packing, toxicity
from engram.llm.common import cut, ensure_checkpoint_dir, fresh, numbered_ids, parallelism, remove, table

#: Ids are broadcast up to this many rows; beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def _sized(ids: DataFrame) -> DataFrame:
    """``ids``, cut, and broadcast if it is small."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; nulls and empty texts are clean; repeated rows are judged each."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _own_ids(docs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, columns) of all rows of ``docs``, each with an id of its own, and (own_id, row) to find the rows by it."""
    single, odd = numbered_ids(docs, name=(name := fresh(docs, "row_id")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = single.select(F.col("doc_id").cast("long").alias("own_id"), whole)
    if odd is not None:
        rows = rows.unionByName(odd.select(F.col(name).alias("own_id"), whole))
    return rows.select(F.col("own_id").alias("doc_id"), *[F.col(f"row.{c}").alias(c) for c in columns]), rows


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the row of its smallest id.

    Rows without an id and rows of a repeated id are documents of their own, after all others: a
    repeated row leaves one, and a row without an id stays if no other document is a near copy.
    """
    texts, rows = _own_ids(docs, "text")
    kept = neardup.near_duplicates(texts).where("kept").select(F.col("doc_id").alias("own_id"))
    return rows.join(_sized(kept), "own_id").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times; every row is a document of its own."""
    sizes, rows = _own_ids(docs, "text", "source")
    taken = mixing.mix(sizes).where("copies > 0").select(F.col("doc_id").alias("own_id"), F.col("copies").cast("int"))
    found = rows.join(_sized(taken), "own_id")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; repeated rows (copies of the mix) are packed each."""
    return packing.pack(docs, salts=max(packing.SALTS, parallelism(spark)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what is between them is written to the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if n:
                remove(spark, f"{folder}/{STAGES[n - 1][0]}")
    return docs


#: The stages (a trained chain, MinHash, random balanced sampling, a tokenizer) can't be expressed in SQL.
ORACLE_SQL = None
