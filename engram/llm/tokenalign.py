"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often they do so in a corpus.

Tokens of both tokenizers are intervals over the bytes of the text with a blank before it.  Where
a token of each ends at one offset, the text is cut; what lies between two cuts is a group, and
all its A tokens are linked with all its B tokens.  Every Arrow partition is aligned in DuckDB:
token interval tables, an ASOF join that finds the cuts, window sums that number the
groups, a range join that puts the other tokenizer's tokens into them, and counts of linked
id pairs.  The partial counts of all partitions are merged in Spark, and the merged counts go
back to the documents.

* A word (with the white space before it) is aligned once and remembered, where both tokenizers
  let no token cross into white space: their files are looked at, and a text or a file for which this doesn't
  hold is aligned as one piece.  The result is that of the whole text.
* Documents are handled in blocks of at most ``BLOCK_BYTES`` of text (one longer document is a block).  A
  block tells Spark its distinct pairs, each with the number of its documents that hold it,
  and gets back one count a pair, so what is shuffled grows with pairs a block, not
  with tokens; a pair's rows are at most one a block.
* Within a group, pairs are counted from distinct ids with their numbers, never token by token.

Defined results
---------------
* Texts that are null or empty, or that one tokenizer doesn't give back byte by byte, have no tokens: zeros and ''.
* Counts are of rows that hold a pair linked: repeated rows and rows of one id count each.
* Null ids are rows like others.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import ensure_checkpoint_dir, give_back, table
from engram.llm.words import ByteLevel, blank_split, is_plain, is_simple, runs, visible_bytes

BLOCK_BYTES = 3 << 20
#: Aligned words that a worker remembers; when there are more, the earliest half (mostly frequent words) stays.
KEPT_WORDS = 200_000
#: Words that are aligned together.
LEARNT_WORDS = 40_000
DUCKDB_MEMORY = "500MB"
#: SentencePiece shows a blank by this character.
BLANK = "▁"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class BytesOf:
    """The bytes of every token of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class LevelSide:
    """A byte-level ``tokenizers`` file, special-token strings read as plain text."""

    def __init__(self, path: str):
        self.level = ByteLevel(path, special=False)
        vocabulary = self.level.tokenizer.get_vocab(with_added_tokens=True)
        shown = {c: b for b, c in enumerate(visible_bytes())}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            tokens[n] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.bytes, self.by_word = BytesOf(tokens), self.level.by_word

    def encode(self, words: list[str], plain_words: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each has) of words with the white space before them; ``plain_words``: all are of simple texts."""
        short = [w[1:] if w[0] == " " and w[1:2] != "\n" else w for w in words]
        if plain_words:
            return self.level.word_ids(short)
        plain = np.array([is_plain(s) and (w[0] in " \n") for w, s in zip(words, short, strict=True)], bool)
        counts, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)] * len(words)
        ids, counts[plain] = self.level.word_ids([s for s, p in zip(short, plain.tolist(), strict=True) if p])
        for n, own in zip(np.flatnonzero(plain).tolist(), np.split(ids, np.cumsum(counts[plain])[:-1]), strict=False):
            parts[n] = own
        for n in np.flatnonzero(~plain).tolist():
            parts[n] = np.array(self.level.ids(words[n]), np.int64)
            counts[n] = len(parts[n])
        return np.concatenate(parts), counts


class PieceSide:
    """A SentencePiece model; it adds the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(n) for n in ids]
        self.bytes = BytesOf([bytes([int(p[3:5], 16)]) if self.model.is_byte(n) else p.replace(BLANK, " ").encode() for n, p in zip(ids, pieces, strict=True)])
        # words are cut before blanks and line feeds
        self.by_word = not any(y in (BLANK, "\n") and not x.isspace() and x != BLANK for p in pieces for x, y in zip(p, p[1:], strict=False))
        self.blank = self.model.piece_to_id(BLANK)

    def encode(self, words: list[str], plain_words: bool) -> tuple[np.ndarray, np.ndarray]:
        """As above; a word that does not begin with a blank is encoded behind the added one, which goes, if it stands for itself."""
        found = self.model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        for n, word in enumerate(words):
            if word[0] != " " and found[n][:1] == [self.blank]:
                found[n] = found[n][1:]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts


#: Groups of tokens: A tokens that end where a B token ends close one.
_GROUPS = """
CREATE OR REPLACE TEMP TABLE grouped_a AS
SELECT id, s, e, (coalesce(sum(cut) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS g
FROM (SELECT a.id, a.s, a.e, CASE WHEN b.e = a.e THEN 1 ELSE 0 END AS cut FROM a ASOF LEFT JOIN b ON a.e >= b.e);
CREATE OR REPLACE TEMP TABLE groups AS
SELECT x.g, x.s, x.e, x.n_a, u.word FROM (SELECT g, min(s) AS s, max(e) AS e, count(*) AS n_a FROM grouped_a GROUP BY g) x ASOF JOIN u ON x.s >= u.s;
CREATE OR REPLACE TEMP TABLE grouped_b AS
SELECT b.id, b.e, g.g FROM b JOIN groups g ON b.s >= g.s AND b.e <= g.e;
"""
_SIZES = "SELECT word, n_a, n_b FROM groups JOIN (SELECT g, count(*) AS n_b FROM grouped_b GROUP BY g) USING (g) ORDER BY g"
_PAIRS = """
SELECT word, x.id AS a, y.id AS b, sum(x.k * y.k)::BIGINT AS times
FROM (SELECT g, id, count(*) AS k FROM grouped_a GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS k FROM grouped_b GROUP BY ALL) y USING (g) JOIN groups USING (g)
GROUP BY ALL ORDER BY word
"""
_TOTALS = """
SELECT doc, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(n_groups)::BIGINT AS n_groups, sum(n_links)::BIGINT AS n_links
FROM held JOIN words USING (word) GROUP BY doc ORDER BY doc
"""
_HELD_PAIRS = """
CREATE OR REPLACE TEMP TABLE linked AS
SELECT doc, a, b, sum(k * times)::BIGINT AS times FROM (SELECT doc, word, count(*) AS k FROM held GROUP BY ALL) JOIN pairs USING (word) GROUP BY ALL;
CREATE OR REPLACE TEMP TABLE distinct_pairs AS
SELECT a, b, held, (row_number() OVER (ORDER BY a, b) - 1)::INTEGER AS pair FROM (SELECT a, b, count(*)::INTEGER AS held FROM linked GROUP BY ALL);
"""


class Aligner:
    """Words aligned so far by number: sizes, the text of their groups, and their linked pairs."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        self.a, self.b = LevelSide(a_path), PieceSide(b_path)
        self.by_word = self.a.by_word and self.b.by_word
        self.names = [str(n) for n in range(max(len(self.a.bytes.tokens), len(self.b.bytes.tokens)))]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.clear()

    def clear(self) -> None:
        #: Numbers of words as ``blank_split`` gives them, and of any others.
        self.plain: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, whether both sides give it back
        self.pairs = np.zeros((4, 0), np.int64)  # word, a, b, times

    def forget(self) -> None:
        """Keep the earliest words, if there are too many."""
        if len(self.texts) > KEPT_WORDS:
            half = KEPT_WORDS // 2
            self.plain = {w: n for w, n in self.plain.items() if n < half}
            self.other = {w: n for w, n in self.other.items() if n < half}
            self.texts, self.sizes = self.texts[:half], self.sizes[:, :half].copy()
            self.pairs = self.pairs[:, self.pairs[0] < half].copy()

    def _interval_table(self, name: str, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes)
        self.db.register("given", pa.table({"id": pa.array(ids.astype(np.int32)), "s": pa.array(ends - sizes), "e": pa.array(ends)}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, words: list[str], plain: bool = False) -> None:
        """Align words (each with its white space) and give them the next numbers."""
        for at in range(0, len(words), LEARNT_WORDS):
            self._learn(words[at : at + LEARNT_WORDS], plain)

    def _learn(self, words: list[str], plain: bool) -> None:
        raw = [w.encode() for w in words]
        lengths = np.array([len(x) for x in raw], np.int64)
        sides = [(side, *side.encode(words, plain)) for side in (self.a, self.b)]
        good = np.ones(len(words), bool)
        whole = b"".join(raw)
        for side, ids, counts in sides:
            if side.bytes.joined(ids) != whole:
                good &= [side.bytes.joined(own) == x for own, x in zip(np.split(ids, np.cumsum(counts)[:-1]), raw, strict=True)]
        sizes = np.zeros((5, len(words)), np.int64)
        sizes[4] = good
        texts, at = [""] * len(words), len(self.texts)
        if good.any():
            kept = [ids[np.repeat(good, counts)] for _, ids, counts in sides]
            for name, (side, _, _), ids in zip("ab", sides, kept, strict=True):
                self._interval_table(name, ids, side.bytes.sizes[ids])
            self._interval_table("u0", np.flatnonzero(good), lengths[good])
            self.db.execute("CREATE OR REPLACE TEMP VIEW u AS SELECT id AS word, s, e FROM u0;" + _GROUPS)
            found = self.db.execute(_SIZES).fetchnumpy()
            own, n_a, n_b = found["word"], found["n_a"].astype(np.int64), found["n_b"].astype(np.int64)
            for n, values in enumerate((n_a, n_b, np.ones_like(n_a), n_a * n_b)):
                np.add.at(sizes[n], own, values)
            shown = [list(map(self.names.__getitem__, ids.tolist())) for ids in kept]
            i, j = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            groups = [x + "|" + y for x, y in zip(map(shown[0].__getitem__, i.tolist()), map(shown[1].__getitem__, j.tolist()), strict=True)]
            wide = np.flatnonzero((n_a > 1) | (n_b > 1))
            for g, x, n, y, m in zip(wide.tolist(), i[wide].tolist(), n_a[wide].tolist(), j[wide].tolist(), n_b[wide].tolist(), strict=True):
                groups[g] = ",".join(shown[0][x : x + n]) + "|" + ",".join(shown[1][y : y + m])
            at_group = 0
            for word, n in enumerate(sizes[2].tolist()):
                texts[word] = ";".join(groups[at_group : at_group + n])
                at_group += n
            pairs = self.db.execute(_PAIRS).fetchnumpy()
            self.pairs = np.concatenate((self.pairs, np.stack([pairs["word"].astype(np.int64) + at, pairs["a"], pairs["b"], pairs["times"]])), axis=1)
            self.db.execute("DROP TABLE a; DROP TABLE b; DROP TABLE u0 CASCADE; DROP TABLE grouped_a; DROP TABLE grouped_b; DROP TABLE groups")
        self.texts += texts
        self.sizes = np.concatenate((self.sizes, sizes), axis=1)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text by number; texts must not be empty."""
        if not self.by_word:
            self.learn(own := list(dict.fromkeys(" " + t for t in texts)))
            place = {w: len(self.texts) - len(own) + n for n, w in enumerate(own)}
            return [np.array([place[" " + t]]) for t in texts]
        simple = [is_simple(t) for t in texts]
        split = [blank_split(t) if own else [] for t, own in zip(texts, simple, strict=True)]
        new = list(set().union(*split).difference(self.plain))
        self.plain.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
        self.learn([w if w[0] == "\n" else " " + w for w in new], plain=True)
        found = [np.fromiter(map(self.plain.__getitem__, words), np.int64, len(words)) for words in split]
        odd = {n: runs(" " + texts[n]) for n, own in enumerate(simple) if not own}
        # a word behind other white space than a blank must stand alone on the pieces' side
        for n, words in odd.items():
            if any(w[0] != " " and self.b.model.encode(w)[:1] != [self.b.blank] for w in words):
                odd[n] = [" " + texts[n]]
        other = list(dict.fromkeys(w for words in odd.values() for w in words if w not in self.other))
        self.other.update(zip(other, range(len(self.texts), len(self.texts) + len(other)), strict=True))
        self.learn(other)
        for n, words in odd.items():
            found[n] = np.array([self.other[w] for w in words])
        return found

    def block(self, texts: list[str]) -> tuple[dict[str, list], dict[str, np.ndarray]]:
        """(columns of the documents, distinct pairs with the number of documents that hold each) of one block."""
        self.forget()
        filled = [n for n, t in enumerate(texts) if t]
        words = self.numbers([texts[n] for n in filled])
        good = [bool(self.sizes[4, w].all()) for w in words]
        filled, words = [n for n, g in zip(filled, good, strict=True) if g], [w for w, g in zip(words, good, strict=True) if g]
        columns: dict[str, list] = {c: [0] * len(texts) for c in ("n_a", "n_b", "n_groups", "n_links")}
        columns |= {"groups_sha256": [""] * len(texts), "pairs": [[]] * len(texts), "times": [[]] * len(texts)}
        if not filled:
            return columns, {c: np.zeros(0, np.int32) for c in ("a", "b", "held")}
        flat = np.concatenate(words)
        used, flat = np.unique(flat, return_inverse=True)
        place = np.full(len(self.texts), -1)
        place[used] = np.arange(len(used))
        pairs = self.pairs[:, place[self.pairs[0]] >= 0]
        given = {
            "held": {"doc": np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words]), "word": flat.astype(np.int32)},
            "words": dict(zip(("word", "n_a", "n_b", "n_groups", "n_links"), (np.arange(len(used), dtype=np.int32), *self.sizes[:4, used]), strict=True)),
            "pairs": {"word": place[pairs[0]].astype(np.int32), "a": pairs[1].astype(np.int32), "b": pairs[2].astype(np.int32), "times": pairs[3]},
        }
        for name, data in given.items():
            self.db.register(name, pa.table({c: pa.array(x) for c, x in data.items()}))
        totals = self.db.execute(_TOTALS).fetchnumpy()
        self.db.execute(_HELD_PAIRS)
        linked = self.db.execute("SELECT doc, pair, times FROM linked JOIN distinct_pairs USING (a, b) ORDER BY doc, pair").fetchnumpy()
        distinct = self.db.execute("SELECT a, b, held FROM distinct_pairs ORDER BY pair").fetchnumpy()
        for name in given:
            self.db.unregister(name)
        self.db.execute("DROP TABLE linked; DROP TABLE distinct_pairs")
        cuts = np.searchsorted(linked["doc"], np.arange(1, len(words)))
        for n, own, pair, times in zip(range(len(words)), words, np.split(linked["pair"], cuts), np.split(linked["times"], cuts), strict=True):
            doc = filled[n]
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                columns[c][doc] = int(totals[c][n])
            columns["groups_sha256"][doc] = hashlib.sha256(";".join(map(self.texts.__getitem__, own.tolist())).encode()).hexdigest()
            columns["pairs"][doc], columns["times"][doc] = pair, times
        return columns, distinct


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("held", pa.list_(pa.int32())),
])
BLOCKS_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>, a array<int>, b array<int>, held array<int>"
RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of ``BLOCKS``: one a document, and one a block (``held`` not null) with its distinct pairs."""

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.cumsum(np.maximum(1, np.asarray(batch.column(2).fill_null(0))))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in blocks(batch):
                columns, distinct = made.block([t or "" for t in part.column(1).to_pylist()])
                rows = {c: pa.nulls(part.num_rows, BLOCKS.field(c).type) for c in ("a", "b", "held")}
                rows |= {"block": pa.array([number] * part.num_rows, pa.int64()), "doc_id": part.column(0)}
                rows |= {c: pa.array(x, BLOCKS.field(c).type) for c, x in columns.items()}
                yield pa.RecordBatch.from_arrays([rows[c] for c in BLOCKS.names], schema=BLOCKS)
                if len(distinct["a"]):
                    rows = {c: pa.nulls(1, BLOCKS.field(c).type) for c in BLOCKS.names} | {"block": pa.array([number], pa.int64())}
                    rows |= {c: pa.array([distinct[c]], BLOCKS.field(c).type) for c in ("a", "b", "held")}
                    yield pa.RecordBatch.from_arrays([rows[c] for c in BLOCKS.names], schema=BLOCKS)
                number += 1
        give_back()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("size")).mapInArrow(align, BLOCKS_SCHEMA)


def with_counts(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links of what all documents say of its pairs."""
    pairs, times = docs["pairs"].combine_chunks(), docs["times"].combine_chunks()
    size = np.asarray(pairs.value_lengths())
    flat, times = np.asarray(pairs.flatten()), np.asarray(times.flatten())
    place = np.asarray(counts["pair"])
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    total[place], best[place] = np.asarray(counts["count"]), np.asarray(counts["best"]).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    sums = []
    for values in (best, total):
        out = np.zeros(len(size), np.int64)
        np.add.at(out, doc, times * values[flat])
        sums.append(pa.array(out))
    made = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]}
    return pa.table(made)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their sums, (a, b, count, best) of every linked id pair) of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    own_a, own_b = default_tokenizers()
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-alignment-{uuid.uuid4().hex}"
    # both what is counted and what the counts go back to come from one written table
    aligned_blocks(docs, a_path or own_a, b_path or own_b).write.parquet(folder)
    read = lambda: spark.read.schema(BLOCKS_SCHEMA).parquet(folder)
    held = read().where("held is not null").select("block", F.posexplode(F.arrays_zip("a", "b", "held")).alias("pair", "x")).select("block", "pair", "x.*")
    counts = held.groupBy("a", "b").agg(F.sum("held").alias("count"))
    # an id of one vocabulary meets no more ids than the other vocabulary has
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    told = held.select("block", "pair", "a", "b").join(counts, ["a", "b"]).select("block", "pair", "count", "best")
    rows = read().where("held is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(with_counts, RESULT_SCHEMA), counts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
