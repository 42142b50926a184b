"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids followed by an end id and is cut into
pieces of at most ``capacity`` tokens (only longer documents are cut).  Pieces
are packed by best fit decreasing: each goes to the tightest open bin that
holds it, found in logarithmic time by a segment tree over remaining
capacities.

Pieces of equal length are interchangeable, so the plan is made on the
histogram of lengths, which has at most ``capacity`` rows at any corpus size:
runs of equal pieces fall into runs of bins with equal remaining capacity.  The
plan is exactly what best fit decreasing gives on all pieces together; the
tasks then place their own pieces by rank, so no task and not the driver ever
holds the documents of a length.

Defined results
---------------
* Null and empty texts are documents of the end id alone (one piece of length 1).
* Equal lengths are ranked by (salt, doc_id, piece, ids_crc32); fully equal rows are
  interchangeable.  Repeated rows are packed once each.  Null ids sort first.
* ``offset`` is gapless from 0 within a sequence.  Extra columns are ignored.
* An empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import cut, give_back, parallelism, table

CAPACITY = 4096
END_ID = 1
SALTS = 64
#: Words kept by a task; when full, the earliest third (mostly frequent words) stays.
CACHE_WORDS = 600_000
#: The pre-tokenizer for which words and pieces may be encoded one by one.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    Where the tokenizer's own split never lets a piece cross white space, ids are
    cached by word; a new word of plain Latin letters is composed of cached
    pieces, and new pieces are encoded together.  Any other tokenizer encodes
    whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        parts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = made["model"]
        self.by_word = (
            (parts[0].get("pattern") or {}).get("Regex") == WORD_SPLIT
            and parts[0].get("invert")
            and parts[0].get("behavior") == "Removed"
            and model.get("end_of_word_suffix") == "</w>"
            and not made.get("post_processor")
            and [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and all(x["content"].startswith("<|") and x["content"].endswith("|>") and not x["lstrip"] and not x["rstrip"] for x in made.get("added_tokens", []))
        )
        if self.by_word:
            self.words: dict[bytes, bytes] = {}
            self.pieces: dict[str, bytes] = {}
            self.split = regex.compile(WORD_SPLIT)
            self.plain = regex.compile(r"[\n\x21-\x7e\xa1-įı-ňŊ-ž]+")
            self.model = self.tokenizer.model
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            hidden = [b for b in range(256) if b not in shown]
            self.shown = {b: chr(256 + n) for n, b in enumerate(hidden)}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece: its bytes in the vocabulary's visible alphabet, merged by the model."""
        seen = piece if piece.isascii() else piece.encode().decode("latin1").translate(self.shown)
        ids = self.pieces[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(seen)])
        return ids

    def _learn(self, new: list[bytes]) -> None:
        words, known, piece_of = self.words, self.pieces, self._piece
        joined = b"\n".join(new).decode()
        if not (self.plain.fullmatch(joined) and unicodedata.is_normalized("NFC", joined)) or "<|" in joined:
            if len(new) == 1:
                words[new[0]] = self._ids(joined)
            else:
                self._learn(new[: len(new) // 2])
                self._learn(new[len(new) // 2 :])
            return
        for word, text in zip(new, joined.lower().split("\n"), strict=True):
            if text.isalpha():
                found = (text,)
            else:
                core = text.rstrip(",.!?;:#$%&*)-")
                found = (core, text[len(core) :]) if core.isalpha() else self.split.findall(text)
            words[word] = b"".join([known.get(piece) or piece_of(piece) for piece in found])

    def forget(self) -> None:
        """Empty the caches: a task's end, so that idle workers hold nothing."""
        if self.by_word:
            self.words, self.pieces = {}, {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_word:
            yield from (self._ids(text.decode()) for text in texts)
            return
        for at in range(0, len(texts), 128):
            split = [text.split() for text in texts[at : at + 128]]
            if len(self.words) > CACHE_WORDS:
                self.words = dict(islice(self.words.items(), CACHE_WORDS // 3))
            if len(self.pieces) > CACHE_WORDS:
                self.pieces = dict(islice(self.pieces.items(), CACHE_WORDS // 3))
            new = set().union(*split).difference(self.words)
            if new:
                self._learn(list(new))
            get = self.words.__getitem__
            for words in split:
                yield b"".join(map(get, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        gc.disable()  # nothing below makes cycles; the caches would be scanned again and again
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for doc_id, raw in zip(ids, made.encode(texts), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        made.forget()
        gc.enable()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(pieces, PIECES_SCHEMA)


class CapacityTree:
    """Segment tree over remaining capacities: which have an open bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        at = self.leaves + room
        self.open[at] = is_open
        while at > 1:
            at //= 2
            now = self.open[2 * at] or self.open[2 * at + 1]
            if self.open[at] == now and at * 2 < self.leaves:
                break
            self.open[at] = now

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        at = self.leaves + least
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.leaves
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing on a histogram of lengths.

    Returns moves (length, first rank, first bin, pieces a bin, offset), sorted by
    (length, first rank), and the number of bins.  A move puts pieces of one
    length, by rank, into consecutive bins, ``pieces a bin`` into each.
    """
    tree, rooms, moves, bins = CapacityTree(capacity), {}, [], 0

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                tree.mark(room, True)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, n, room = bins, -(-left // each), capacity
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    tree.mark(room, False)
            each = room // length
            whole = min(n, left // each)
            rest = left - whole * each if whole < n else 0
            moves.append((length, rank, first, each, capacity - room))
            give(room - each * length, first, whole)
            used = whole
            if 0 < rest < each:
                give(room - rest * length, first + whole, 1)
                used += 1
            else:
                rest = 0
            give(room, first + used, n - used)
            rank += whole * each + rest
            left -= whole * each + rest
    moves.sort()
    return np.array(moves, "i8").reshape(-1, 5), bins


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, salts: int = SALTS,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and offset."""
    pieces = cut(tokenised_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id)).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    )
    counts = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    moves, _ = best_fit_plan(histogram, capacity)

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    # the window has dealt the pieces by these keys already, so the join moves the few counts only
    ranked = pieces.withColumn("at", F.row_number().over(local)).join(firsts, ["length", "salt"])

    keys = moves[:, 0] * (1 << 42) + moves[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rank = frame.pop("rank").to_numpy()
            length = frame["length"].to_numpy()
            move = moves[np.searchsorted(keys, length * (1 << 42) + rank, side="right") - 1]
            within = rank - move[:, 1]
            frame["sequence_id"] = move[:, 2] + within // move[:, 3]
            frame["offset"] = move[:, 4] + within % move[:, 3] * length
            yield frame

    return ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at") - 1).alias("rank")
    ).mapInPandas(place, PIECES_SCHEMA + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), salts=max(SALTS, parallelism(spark)))
