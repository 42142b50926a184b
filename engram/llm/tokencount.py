"""Token counts of texts behind a cache of digests.

A count is stored under two digests: one of the normalised content, one of the tokenizer's
version (its file, its library and the normal form).  ``token_counts`` joins the digests of
the texts to what is stored, encodes each distinct text that is missing once, appends
those counts to the cache and joins again.  The digests are computed in the JVM and the
joins move digests only; a text travels once, to meet its copies, and only if it is missing.

The cache is a folder of Parquet batches ``tokenizer=<version>/<batch>``, written by Spark's own
committer, so that a lost executor or a failed job leaves no partial file in it.  Counts of two
runs that missed the same text are equal, and are read once.  Another tokenizer file, or another
release of its library, finds nothing stored and starts its own part.

Defined results
---------------
* A null text is empty: 0 bytes and the tokens of the empty text (0, or what the tokenizer
  gives it).  Texts are encoded whole, at any length.
* Special-token strings inside texts are read as the library's default does; nothing is
  added, truncated or padded.
* Repeated rows and null ids are rows like others.  Extra columns are ignored.  An empty
  table gives no rows and appends nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import cut, ensure_checkpoint_dir, give_back, remove, table
from engram.llm.neardup import split_join
from engram.llm.words import counter

#: Missing digests (32 bytes each) are broadcast up to this many; beyond that both sides are shuffled.
BROADCAST_DIGESTS = 200_000
#: Texts whose words are looked up together.
TEXTS = 64
LIMIT = 1024
CACHE_SCHEMA = "content binary, n_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _collapses(tokenizer: str) -> bool:
    """Whether the tokenizer itself makes a run of white space one blank before it does anything else with blanks."""
    if tokenizer.endswith(".model"):
        return False
    with open(tokenizer, encoding="utf-8") as file:
        made = json.load(file).get("normalizer") or {}
    rule = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return rule in [made, *made.get("normalizers", [])]


def normal_form(text: Column, tokenizer: str) -> Column:
    """What two texts must share to have one count: null is empty, and runs of white space are one blank where the tokenizer has it so."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ") if _collapses(tokenizer) else text


def tokenizer_version(tokenizer: str) -> str:
    """Digest of the tokenizer's file, its library's release and the normal form."""
    library = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    with open(tokenizer, "rb") as file:
        return hashlib.sha256(f"{library} {version(library)} {_collapses(tokenizer)} ".encode() + file.read()).hexdigest()


class CountCache:
    """Stored counts of one tokenizer version below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.folder = spark, f"{folder}/tokenizer={tokenizer_version(tokenizer)}"

    def _batches(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(path) if files.exists(path) else []
        return sorted(x.getPath().toString() for x in found)

    def read(self) -> DataFrame | None:
        """(content, n_tokens), each digest once; nothing if nothing is stored."""
        batches = self._batches()
        if not batches:
            return None
        stored = self.spark.read.schema(CACHE_SCHEMA).parquet(*batches)
        return stored if len(batches) == 1 else stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.write.parquet(f"{self.folder}/{uuid.uuid4().hex}")

    def compact(self) -> None:
        """Make one batch of all: readers find either the old ones or more than they need."""
        before = self._batches()
        if len(before) > 1:
            self.append(self.read())
            for batch in before:
                remove(self.spark, batch)


def encoded(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.counts(part.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])
        give_back()

    return texts.mapInArrow(counts, CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache_folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; what the cache misses is in it afterwards."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    cache = CountCache(spark, cache_folder, tokenizer)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    normal = normal_form(text, tokenizer)
    content = F.unhex(F.sha2(normal.cast("binary"), 256)).alias("content")
    rows = cut(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content))

    stored, texts = cache.read(), docs.select(content, normal.alias("text"))
    if stored is not None:
        missing = cut(rows.select("content").distinct().join(stored, "content", "left_anti"))
        few = missing.count() <= BROADCAST_DIGESTS
        texts = texts.join(F.broadcast(missing) if few else missing, "content", "left_semi")
        missed = not missing.isEmpty()
    else:
        missed = not rows.isEmpty()
    if missed:
        # copies meet within a task before they are dealt, so a text with very many of them travels once a task
        cache.append(encoded(texts.groupBy("content").agg(F.first("text").alias("text")), tokenizer))
    stored = cache.read()
    if stored is None:
        return rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    return split_join(rows, stored, "content").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a cache of this run's own, so that every distinct text is encoded and no earlier run decides anything."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    return token_counts(table(spark, sf_dir, "documents"), folder).withColumn("over_limit", F.col("n_tokens") > LIMIT)
