"""Summaries of conversations that grow with them: an incremental fold with a mark of what it covers.

Turns are dealt by conversation and sorted by time, and a task streams through them: it holds one
summary and one open chunk, never a conversation.  ``fold(summary, chunk)`` is the injected step, a
model's in production; a chunk closes when its words reach ``chunk_words``, and the mark is the time and id of the
last turn that a summary covers, so that turns of the mark's own time are neither lost nor folded twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_WORDS, MAX_WORDS, TOLERANCE = 3500, 250, 50
SCHEMA = "conversation_id long, summary string, covers_us long, covers_turn long, folded long"


def bounded(summary: str, most: int = MAX_WORDS, tolerance: int = TOLERANCE) -> str:
    """A summary that is far too long is cut to its first ``most`` words."""
    words = summary.split()
    return " ".join(words[:most]) if len(words) > most + tolerance else summary


class _Open:
    """What a conversation has so far: its summary, the mark, and the open chunk."""

    def __init__(self, conversation: int, summary: str, fold: Callable[[str, str], str], chunk_words: int):
        self.conversation, self.summary, self.fold, self.chunk_words = conversation, summary or "", fold, chunk_words
        self.chunk: list[str] = []
        self.words = self.folded = 0
        self.mark = self.last = None
        self.failed = False

    def close(self) -> None:
        made = bounded(self.fold(self.summary, "\n\n".join(self.chunk)) or "")
        self.failed = not made
        if made:
            self.summary, self.mark, self.folded = made, self.last, self.folded + len(self.chunk)
        self.chunk, self.words = [], 0

    def take(self, us: int, turn: int, text: str) -> None:
        if self.failed:
            return
        self.chunk.append(text)
        self.words, self.last = self.words + len(text.split()), (us, turn)
        if self.words >= self.chunk_words:
            self.close()

    def row(self, partial: bool) -> tuple | None:
        if partial and self.chunk and not self.failed:
            self.close()
        if self.failed or self.mark is None:
            return None
        return (self.conversation, self.summary, *self.mark, self.folded)


def fold_summaries(
    turns: DataFrame, stored: DataFrame, fold: Callable[[str, str], str], window_tokens: int, chunk_words: int = CHUNK_WORDS, partial: bool = True,
) -> DataFrame:
    """Rows (conversation_id, summary, covers_us, covers_turn, folded) to write for the conversations of turns (conversation_id, turn_id, us, text).

    ``stored`` has the same columns (``folded`` apart).  A conversation without a summary begins one when its text outgrows the window; one with
    a summary folds the turns after its mark.  If a step fails (gives nothing) the conversation keeps its old row, so it is
    never advanced by half.  With ``partial``, what is left of a chunk at the end is folded too; without, it waits for
    the next run, and the summaries of any number of runs are those of one.  Null texts are empty; turns without a time or conversation are dropped.
    """
    rows = turns.where("conversation_id is not null and us is not null").select("conversation_id", "turn_id", "us", F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conversation_id").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
    begun = stored.select("conversation_id", "summary", "covers_us", "covers_turn")
    due = sizes.join(begun, "conversation_id", "left").where((F.col("tokens") > window_tokens) | F.col("summary").isNotNull()).drop("tokens")
    new = rows.join(due, "conversation_id").where(
        F.col("covers_us").isNull() | (F.col("us") > F.col("covers_us")) | ((F.col("us") == F.col("covers_us")) & (F.col("turn_id") > F.col("covers_turn")))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at = [c.split()[0] for c in SCHEMA.split(", ")], None
        for frame in frames:
            out = []
            for c, summary, turn, us, text in zip(*(frame[n] for n in ("conversation_id", "summary", "turn_id", "us", "text")), strict=True):
                if at is None or at.conversation != c:
                    out += [at.row(partial)] if at else []
                    at = _Open(c, None if pd.isna(summary) else summary, fold, chunk_words)
                at.take(us, turn, text)
            yield pd.DataFrame([x for x in out if x], columns=names)
        if at and (last := at.row(partial)):
            yield pd.DataFrame([last], columns=names)

    return new.repartition("conversation_id").sortWithinPartitions("conversation_id", "us", "turn_id").mapInPandas(run, SCHEMA)
