"""Chunking of texts into pieces of a token budget, as an Arrow-batched table operator.

A text is first taken apart into sections (a heading begins one) and their units: sentences of
prose, lines of fenced code.  Sections are packed one by one: the running sums of the units' sizes tell
where each chunk ends, and the last words of a chunk lead into the next of its section.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame

# What fences, headings and the ends of sentences look like.
FENCE = re.compile(r"(```.*?```)", re.S)
HEADING = re.compile(r"^(#{1,6}\s.+)$", re.M)
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

Ruler = Callable[[str], int]


def quarter(text: str) -> int:
    """The deterministic ruler."""
    return len(text) // 4


def _filled(parts: list[str]) -> list[str]:
    return [p for p in parts if p.strip()]


def sections(text: str) -> list[list[str]]:
    """Units by section: what stands before the first heading, then each heading with what follows it."""
    out: list[list[str]] = [[]]
    for n, segment in enumerate(FENCE.split(text)):
        if n % 2:
            out[-1] += _filled(segment.splitlines())
            continue
        at = 0
        for heading in HEADING.finditer(segment):
            out[-1] += _filled(SENTENCE_END.split(segment[at : heading.start()].strip()))
            out.append([heading[0].strip()])
            at = heading.end()
        out[-1] += _filled(SENTENCE_END.split(segment[at:].strip()))
    return [units for units in out if units]


def pack(units: list[str], sizes: list[int], budget: int, joint: str, overlap: int = 0, ruler: Ruler = quarter) -> Iterator[str]:
    """Runs of units that fit the budget, each at least one unit; the last ``overlap`` words of one begin the next, at its cost."""
    ends = [0, *accumulate(sizes)]
    at, lead = 0, ""
    while at < len(units):
        room = budget - (ruler(lead) if lead else 0)
        stop = max(at + 1, bisect_right(ends, ends[at] + room) - 1)
        chunk = joint.join([lead, *units[at:stop]] if lead else units[at:stop])
        yield chunk
        at, lead = stop, " ".join(chunk.split()[-overlap:]) if overlap else ""


def pieces(unit: str, budget: int, ruler: Ruler) -> Iterator[str]:
    """A unit beyond the budget, by words; a word beyond it, by characters."""
    size = lambda word: ruler(word + " ")
    for giant, words in groupby(unit.split(), lambda w: size(w) > budget):
        if not giant:
            words = list(words)
            yield from pack(words, [size(w) for w in words], budget, " ")
            continue
        for word in words:
            step = max(1, budget * len(word) // size(word))
            yield from (word[n : n + step] for n in range(0, len(word), step))


def chunks(text: str | None, budget: int = 550, overlap: int = 50, ruler: Ruler = quarter) -> list[str]:
    """The chunks of a text in order; none spans a heading, and a unit beyond the budget stands alone in pieces."""
    out: list[str] = []
    cost = lambda unit: ruler(unit) + 1  # noqa: E731  (the line feed that joins it)
    for units in sections(text or ""):
        for giant, run in groupby(units, lambda u: cost(u) > budget):
            run = list(run)
            if giant:
                out += [piece for unit in run for piece in pieces(unit, budget, ruler)]
            else:
                out += pack(run, [cost(u) for u in run], budget, "\n", overlap, ruler)
    return out


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 550, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk, text, tokens) of all documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, c, quarter(c)) for i, t in zip(frame[id_col], frame[text_col], strict=True) for n, c in enumerate(chunks(t, budget, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text", "tokens"])

    return docs.select(id_col, text_col).mapInPandas(run, "doc_id long, chunk int, text string, tokens long")
