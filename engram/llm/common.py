"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.lineage import cut, ensure_checkpoint_dir  # noqa: F401  (the operators import them from here)

#: A word of the contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run wrote and no longer reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return what a Python worker has freed to the system, so that idle workers hold little; called at a task's end."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, cut, with a number from 0 in the order of a hash of all columns.

    The order does not depend on how the table is stored, but for fully equal rows, which are
    interchangeable; equal rows are dealt over partitions as others are.
    """
    spark, columns = rows.sparkSession, [F.col(f"`{c}`") for c in rows.columns]
    whole = F.struct(*columns)
    placed = rows.select(whole.alias("row"), F.xxhash64(*columns).alias("place"), F.monotonically_increasing_id().alias("came"))
    dealt = placed.repartitionByRange(parallelism(spark), "place", "came").sortWithinPartitions("place", "came")
    dealt = cut(dealt.select("row", F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    starts, at = [F.lit(0).cast("long"), F.lit(0).cast("long")], 0
    # one small row a partition
    for row in sorted(dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(row["part"]).cast("long"), F.lit(at).cast("long")]
        at += row["n"]
    start = F.element_at(F.map_from_entries(F.array(*[F.struct(starts[n], starts[n + 1]) for n in range(2 if len(starts) > 2 else 0, len(starts), 2)])), part)
    return dealt.select("row.*", (start + inside).alias(name))


def numbered_ids(docs: DataFrame, id_col: str = "doc_id", name: str = "row_id") -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id no other row has, all other rows, if any, with an id of their own in column ``name``).

    Rows without an id and rows of a repeated id get ids that no row of ``docs`` has, above all of
    them (below, where there is no room above).
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    repeated = cut(ids.where("n > 1 and id is not null").select("id"))
    low, high, n, known = docs.agg(F.min(id_col), F.max(id_col), F.count("*"), F.count(id_col)).first()
    if n == known and repeated.isEmpty():
        return docs, None
    single, odd = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    if not repeated.isEmpty():
        of = F.col(id_col) == repeated["id"]
        odd = odd.unionByName(single.join(repeated, of, "left_semi"))
        single = single.join(repeated, of, "left_anti")
    # rows without an id come last
    odd = numbered(odd, name)
    number = F.col(name) + F.when(F.col(id_col).isNull(), F.lit(n)).otherwise(F.lit(0))
    if (high or 0) < 1 << 62:
        return single, odd.withColumn(name, number + F.lit(max(high or 0, 0) + 1))
    return single, odd.withColumn(name, F.lit(min(low, 0) - 1 - 2 * n) + number)
