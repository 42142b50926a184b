"""Toxicity by a linear-chain conditional random field over the words of a text.

A two-label chain (clean, toxic) tags the words of whole documents.  Token labels
come from the document labels: in documents labelled toxic, words whose form or
beginning is far commoner there than in clean documents are the toxic tokens;
all other tokens are clean.  The chain is trained by exact gradients
(forward-backward) on a bounded sample of labelled rows.  Its marginals are
aggregated to a document score by a logistic regression on the strongest marginal
and the expected number of toxic words, and give the offending offsets.

Only the text is an input of a score.

Defined results
---------------
* Null, empty and wordless texts have no tokens; they get the score of a text
  without toxic words, and no offsets.
* Without labels of both kinds among the training rows nothing can be learnt:
  every score is the share of toxic labels among them (0 without labels).
* Labels that are null, and labels without a document, train nothing.  A document
  with several labels counts once for each.
* Repeated rows get their result each.  Extra columns are ignored.  An empty table
  gives no rows.
* ``sample_rows`` bounds the training rows of each label (chosen by a hash of
  the id) and ``sample_chars`` the length of a training text; scoring has no bounds.
  One task trains on this sample and returns the weights; the driver holds no texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import fresh, give_back, id_remainder, table

HELD_OUT_MODULUS = 5
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 100_000
FEATURES = 1 << 17
PREFIXES = (3, 4, 5, 6, 7)
SUFFIXES = (3, 4)
N_FEATURES = 2 + len(PREFIXES) + len(SUFFIXES)
MIN_DOCS, MIN_LOG_ODDS = 4, 2.5
EPOCHS, RATE, RIDGE = 30, 0.3, 1e-3
GROUP, CELLS = 512, 1 << 19
#: Words whose odds a task keeps.
CACHE_WORDS = 250_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[\W\d_]+")


def stem(word: bytes) -> str:
    """A word's letters, in lower case."""
    text = word.decode("utf-8", "replace").lower()
    return text if text.isalpha() else _LETTERS.sub("", text)


def features(letters: str) -> list[int]:
    """Hashed features of a word: a constant, its form, its beginnings and its ends."""
    out = [0, zlib.crc32(b"w" + letters.encode())]
    n = len(letters)
    for k in PREFIXES:
        out.append(zlib.crc32(f"p{letters[:k]}".encode()) if n >= k else 0)
    for k in SUFFIXES:
        out.append(zlib.crc32(f"s{letters[-k:]}".encode()) if n >= k else 0)
    return [out[0], *(1 + x % (FEATURES - 1) if x else 0 for x in out[1:])]


def chain_marginals(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, starts: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on a padded (time, sequence) array of emission odds; sequences by falling length.

    ``moves[i, j]`` is the potential of label i before label j, ``starts`` the odds of a
    toxic first word.  Returns the toxic marginals and the chance that a word and the
    next are both toxic, clean-toxic or toxic-clean, summed over all: (marginals, pair sums).
    """
    steps, n = odds.shape
    forward, back = np.empty_like(odds), np.ones_like(odds)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    (cc, ct), (tc, tt) = moves.tolist()
    forward[0] = odds[0] * starts
    for t in range(1, steps):
        k = active[t]
        r = forward[t - 1, :k]
        forward[t, :k] = odds[t, :k] * (r * tt + ct) / (r * tc + cc)
        forward[t, k:] = 0
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        b = odds[t + 1, :k] * back[t + 1, :k]
        back[t, :k] = (tc + tt * b) / (cc + ct * b)
    both = forward * back
    return both / (1 + both), forward, back


def pair_sums(odds, forward, back, lengths, moves) -> np.ndarray:
    """Expected counts of each pair of neighbouring labels."""
    inside = np.arange(1, odds.shape[0])[:, None] < lengths[None, :]
    a, b = forward[:-1], odds[1:] * back[1:]
    parts = [moves[0, 0] * np.ones_like(a), moves[0, 1] * b, moves[1, 0] * a, moves[1, 1] * a * b]
    total = np.where(inside, sum(parts), 1)
    return np.array([np.where(inside, p / total, 0).sum() for p in parts]).reshape(2, 2)


def grouped(lengths: np.ndarray, size: int = GROUP, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Indices of non-empty sequences, by falling length, in groups of a bounded area."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = int(max(1, min(size, cells // lengths[order[at]])))
        yield order[at : at + n]
        at += n


def padded(values: np.ndarray, first: np.ndarray, lengths: np.ndarray, fill) -> np.ndarray:
    """(time, sequence) array of the runs of ``values`` that begin at ``first``."""
    time = np.arange(lengths[0])[:, None]
    inside = time < lengths[None, :]
    return np.where(inside, values[np.where(inside, first[None, :] + time, 0)], fill)


@dataclass
class Chain:
    """Trained weights: emissions of hashed features, label pairs, start, and the document regression."""

    weights: np.ndarray
    moves: np.ndarray
    starts: float
    document: np.ndarray
    constant: float | None = None

    def dumps(self) -> bytes:
        constant = np.nan if self.constant is None else self.constant
        return np.concatenate((self.moves.ravel(), [self.starts], self.document, [constant], self.weights)).astype("<f8").tobytes()

    @classmethod
    def loads(cls, data: bytes) -> Chain:
        x = np.frombuffer(data, "<f8")
        return cls(x[9:], x[:4].reshape(2, 2), float(x[4]), x[5:8], None if np.isnan(x[8]) else float(x[8]))

    def emissions(self, words: list[bytes]) -> list[float]:
        """Emission odds of words."""
        table_ = np.array([features(stem(w)) for w in words], np.int32).reshape(-1, N_FEATURES)
        return np.exp(np.clip(emission_sums(self.weights, table_), -18, 18)).tolist()

    def marginals(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first, out = np.cumsum(lengths) - lengths, np.zeros(len(odds))
        for group in grouped(lengths):
            long = lengths[group]
            made = chain_marginals(padded(odds, first[group], long, 0.0), long, self.moves, self.starts)[0]
            inside = np.arange(long[0])[:, None] < long[None, :]
            out[(first[group][None, :] + np.arange(long[0])[:, None])[inside]] = made[inside]
        return out

    def scores(self, marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        return 1 / (1 + np.exp(-document_inputs(marginals, lengths) @ self.document))


def document_inputs(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, log-odds of the strongest marginal, log of the expected toxic words) of each document."""
    first, full = np.cumsum(lengths) - lengths, lengths > 0
    most, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    if full.any():
        most[full] = np.maximum.reduceat(marginals, first[full])
        total[full] = np.add.reduceat(marginals, first[full])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(len(lengths)), np.log(most / (1 - most)), np.log(total + 1e-2)], 1)


def read_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers of all tokens, words of each text, distinct words)."""
    number: dict[bytes, int] = {}
    parts = [np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    return np.concatenate(parts), np.array([len(p) for p in parts]), list(number)


def toxic_words(tokens: np.ndarray, lengths: np.ndarray, stems: list[str], toxic: np.ndarray) -> np.ndarray:
    """Which distinct words are toxic where they stand in toxic documents: those with a form far commoner there.

    Forms are a word and its beginnings, as 32-bit hashes in flat arrays.
    """
    none = zlib.crc32(b"")
    hashes = (zlib.crc32(f"{s[:k]}*".encode() if k else s.encode()) if len(s) >= k else none for s in stems for k in (0, *PREFIXES))
    forms = np.fromiter(hashes, np.uint32, len(stems) * (1 + len(PREFIXES))).reshape(-1, 1 + len(PREFIXES))
    values, place = np.unique(forms, return_inverse=True)
    place = place.reshape(forms.shape)
    counts, at = np.zeros((2, len(values))), 0
    for size, label in zip(lengths.tolist(), toxic.tolist(), strict=True):
        counts[int(label), np.unique(place[np.unique(tokens[at : at + size])])] += 1
        at += size
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    marked = (counts[1] >= MIN_DOCS) & (odds >= MIN_LOG_ODDS) & (values != none)
    return marked[place].any(1)


def emission_sums(theta: np.ndarray, table_: np.ndarray) -> np.ndarray:
    return sum(theta[column] for column in table_.T)


def train(texts: list[bytes], toxic: np.ndarray, toxic_share: float, epochs: int = EPOCHS) -> Chain:
    """Fit the chain on texts with document labels; ``toxic_share`` is the share of label 1 among all training labels."""
    flat = Chain(np.zeros(FEATURES), np.ones((2, 2)), 1.0, np.zeros(3), toxic_share)
    if not len(texts) or toxic.min() == toxic.max():
        return flat
    tokens, lengths, distinct = read_tokens(texts)
    stems = [stem(w) for w in distinct]
    gold = toxic_words(tokens, lengths, stems, toxic)[tokens] & np.repeat(toxic == 1, lengths)
    table_ = np.fromiter((x for s in stems for x in features(s)), np.int32, len(stems) * N_FEATURES).reshape(-1, N_FEATURES)
    n_words = len(distinct)
    del stems, distinct
    first = np.cumsum(lengths) - lengths
    groups = list(grouped(lengths))

    theta, pair, start = np.zeros(FEATURES), np.zeros((2, 2)), 0.0
    theta[0] = np.log((gold.sum() + 1) / (len(gold) + 2)) / N_FEATURES
    state = [[np.zeros(FEATURES), np.zeros(FEATURES)], [np.zeros((2, 2)), np.zeros((2, 2))], [0.0, 0.0]]
    for epoch in range(1, epochs + 1):
        emissions = np.exp(np.clip(emission_sums(theta, table_), -18, 18))
        moves, starts = np.exp(pair), float(np.exp(start))
        by_word, d_pair, d_start = np.zeros(n_words), np.zeros((2, 2)), 0.0
        for group in groups:
            long = lengths[group]
            ids, truth = padded(tokens, first[group], long, 0), padded(gold, first[group], long, False)
            inside = np.arange(long[0])[:, None] < long[None, :]
            odds = np.where(inside, emissions[ids], 0.0)
            made, forward, back = chain_marginals(odds, long, moves, starts)
            by_word += np.bincount(ids[inside], (truth - made)[inside], n_words)
            d_start += float((truth[0] - made[0]).sum())
            both, (a, b) = inside[1:], (truth[:-1], truth[1:])
            seen = np.array([(~a & ~b & both).sum(), (~a & b & both).sum(), (a & ~b & both).sum(), (a & b & both).sum()])
            d_pair += seen.reshape(2, 2) - pair_sums(odds, forward, back, long, moves)
        d_theta = sum(np.bincount(column, by_word, FEATURES) for column in table_.T) - RIDGE * theta * len(texts)
        for n, (value, slope) in enumerate(((theta, d_theta), (pair, d_pair - RIDGE * pair), (start, d_start - RIDGE * start))):
            state[n][0] = 0.8 * state[n][0] + 0.2 * slope
            state[n][1] = 0.95 * state[n][1] + 0.05 * slope**2
            step = RATE * (state[n][0] / (1 - 0.8**epoch)) / (np.sqrt(state[n][1] / (1 - 0.95**epoch)) + 1e-8)
            if n == 0:
                theta = value + step
            elif n == 1:
                pair = value + step
            else:
                start = value + step
    made = Chain(theta, np.exp(np.clip(pair, -9, 9)), float(np.exp(np.clip(start, -9, 9))), np.zeros(3))
    odds = np.exp(np.clip(emission_sums(theta, table_), -18, 18))[tokens]
    inputs = document_inputs(made.marginals(odds, lengths), lengths)
    share = toxic.mean()
    weight = np.where(toxic == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-inputs @ beta))
        slope = inputs.T @ (weight * (toxic - p)) - 1e-2 * beta
        bend = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(bend, slope)
    made.document = beta
    return made


def spans_of(text: bytes, marginals: np.ndarray) -> list[dict]:
    """(start, length, chance) in characters of the words with a marginal of at least one half."""
    out, bytes_at, chars_at = [], 0, 0
    hit = marginals >= 0.5
    for word, toxic, p in zip(WORD.finditer(text), hit.tolist(), marginals.tolist(), strict=True):
        if toxic:
            chars_at += len(text[bytes_at : word.start()].decode())
            bytes_at = word.start()
            out.append({"start": chars_at, "length": len(word[0].decode()), "chance": p})
    return out


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans) of every row of ``docs``."""
    return _scored(docs.select(F.col(id_col).cast("long"), F.col(text_col)), chain, text_col, keep=[id_col])


def clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with the columns they had."""
    scored = _scored(docs, chain, text_col, keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _scored(docs: DataFrame, chain: Chain, text_col: str, keep: list[str]) -> DataFrame:
    bare = keep == docs.columns
    names = [fresh(docs, "score"), fresh(docs, "predicted")] if bare else ["score", "predicted", "spans"]
    kinds = ["double", "int", "array<struct<start:long,length:long,chance:double>>"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("chance", pa.float64())]))
    text_at, kept_at = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or b"" for t in part.column(text_at).cast(pa.binary()).to_pylist()]
                words = [t.lower().split() for t in texts]
                if len(known) > CACHE_WORDS:
                    known = dict(islice(known.items(), CACHE_WORDS // 3))
                new = list(set().union(*words).difference(known))
                known.update(zip(new, chain.emissions(new), strict=True))
                odds = [np.fromiter(map(known.__getitem__, doc), np.float64, len(doc)) for doc in words]
                lengths = np.array([len(w) for w in words])
                marginals = chain.marginals(np.concatenate(odds), lengths)
                scores = chain.scores(marginals, lengths)
                made = [pa.array(scores), pa.array((scores >= 0.5).astype("i4"))]
                if not bare:
                    ends = np.cumsum(lengths)
                    spans = [
                        spans_of(t, m) if (m := marginals[e - n : e]).size and m.max() >= 0.5 else []
                        for t, n, e in zip(texts, lengths, ends, strict=True)
                    ]
                    made.append(pa.array(spans, span))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept_at] + made, names=keep + names)
        del known
        give_back()

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {k}" for n, k in zip(names, kinds, strict=False)]
    return docs.mapInArrow(score, ", ".join(fields))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> Chain:
    """Train on the labelled rows that are not held out; at most ``sample_rows`` of each label."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) != 0)
    )
    totals = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample_rows small rows: a proven bound for the broadcast; of the rows of one id the text
    # with the least digest trains, so the sample is bounded however often an id is repeated
    raw = F.col("text").cast("binary")
    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .where(F.length("text") <= sample_chars)
        .join(F.broadcast(chosen.distinct()), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.struct(F.crc32(raw).alias("crc"), raw.alias("text"))).alias("least"))
        .select("doc_id", "toxic", F.col("least.text").alias("text"))
    )

    # one task sees the bounded sample and returns weights, so the driver never holds texts
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.append((doc_id, label, zlib.crc32(text), text))
        found.sort(key=lambda r: r[:3])
        chain = train([r[3] for r in found], np.array([r[1] for r in found], np.int64), share, epochs)
        del found
        yield pa.RecordBatch.from_arrays([pa.array([chain.dumps()], pa.binary())], names=["chain"])
        give_back()

    made = rows.repartition(1).mapInArrow(fitted, "chain binary").collect()
    return Chain.loads(made[0]["chain"]) if made else train([], np.zeros(0), share)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return tag(docs, chain).select(
        "doc_id", (id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == 0).alias("held_out"), "score", "predicted"
    )
