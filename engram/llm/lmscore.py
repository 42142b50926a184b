"""Language-model scoring with a gated recurrent network.

The network (a GRU in numpy) reads whole documents word by word; its state is
carried across windows, so a score is the log-likelihood of the complete text.
The output softmax is class-factored, P(word) = P(class | state) * P(word | class):

* the ``SOFTMAX_WORDS`` commonest words form ``WORD_CLASSES`` classes by frequency,
  with a softmax over the words of a class that depends on the state;
* every other word belongs to one of ``FORM_CLASSES`` classes by its ending, in
  which its probability is its smoothed share of the class's training tokens.

Counts, totals and class totals are exact and cover all training documents (all
that are not held out); they also set the biases the network starts from.  The
network's weights are trained by truncated backpropagation on all training documents,
of any length: whole texts are cut into pieces, and tasks that grow in number with the
input train on some pieces each; their weights are averaged, by tasks, after each of a few rounds.

Counts of the ``LOCAL_WORDS`` commonest words travel with the tasks (a fixed bound);
the other words of a document meet their counts in a shuffled join.

Defined results
---------------
* Null, empty and wordless texts consist of the end token alone.
* Without training documents N = V = 0 and every base term is log10(1) = 0.
* A null id counts as the empty text for the split.  Repeated rows are scored each,
  and counted each in training.
* Very long texts are read in windows; no matrix over a whole text is made.
* Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import cut, id_remainder, table

HELD_OUT_MODULUS = 10
SOFTMAX_WORDS, WORD_CLASSES, FORM_CLASSES = 4096, 32, 32
LOCAL_WORDS = 131_072
HIDDEN, LANES, WINDOW = 32, 512, 32
#: Lanes that train abreast, at most and at least, and the steps of a task that come before more lanes.
TRAIN_LANES, FEW_LANES, TRAIN_WINDOW, TRAIN_STEPS, RATE = 1024, 32, 16, 60, 0.003
#: Words of a piece of a text, of a task in a round, and the rounds after which weights are averaged.
PIECE_WORDS, TASK_WORDS, TRAIN_ROUNDS = 1024, 1_000_000, 4
#: Weights that one task adds up.
FAN_IN = 32
SMOOTH = 0.1
#: The end token; no word is empty.
END = b""
#: Bytes of text that a task splits into words at once.
SLICE_BYTES = 48_000_000
#: Tokens whose softmax is made at once, so that it stays in a cache.
BLOCK = 512
REACH = 40


def form_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % FORM_CLASSES


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` by at most ``SLICE_BYTES`` of their last column, or one row, at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def words_by_text(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all ``texts`` (binary), how many each has), as ``words_of`` tells them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, n = lists.flatten().view(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py() and len(words):
        number = np.repeat(np.arange(len(n)), n)
        n = np.bincount(number[full.to_numpy(zero_copy_only=False)], minlength=len(n))
        words = words.filter(full)
    return words, n


# --- corpus counts -------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs``, the end token included; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = pc.value_counts(words_by_text(batch.column(0))[0])
            words, n = seen.field(0), seen.field(1)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([batch.num_rows], pa.int64())])], names=["word", "n"]
            )

    return docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- the network ---------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> None:
    """1 / (1 + exp(-x)) in place, as 1 - 1 / (1 + exp(x))."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    np.subtract(1, x, out=x)


@dataclass
class Network:
    """Weights; ``words`` softmax words in ``word_classes`` classes of ``width``, then ``forms`` form classes."""

    words: int
    word_classes: int
    width: int
    forms: int = FORM_CLASSES
    hidden: int = HIDDEN
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, counts: np.ndarray, form_counts: np.ndarray, seed: int = 6) -> Network:
        """A network whose biases give the words' shares in the training corpus; ``counts`` by falling frequency."""
        words = len(counts)
        width = max(1, -(-words // WORD_CLASSES))
        classes = -(-words // width)
        net = cls(words, classes, width, len(form_counts))
        rng, h = np.random.default_rng(seed), net.hidden
        padded = np.zeros(classes * width)
        padded[:words] = counts
        by_class = np.concatenate((padded.reshape(classes, width).sum(1), form_counts)) + SMOOTH
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype("f4")
        net.weights = {
            "inputs": small(words + len(form_counts), 3 * h),
            "gates": small(h, 2 * h), "candidate": small(h, h),
            "classes": np.zeros((h, len(by_class)), "f4"), "class_bias": np.log(by_class / by_class.sum()).astype("f4"),
            "words": np.zeros((classes, h, width), "f4"),
            "word_bias": np.where(padded > 0, np.log(np.maximum(padded, 1)), -30).reshape(classes, width).astype("f4"),
        }
        net.weights["inputs"][:, :h] -= 1.5  # gates that start nearly shut remember a document's language
        return net

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.width, self.word_classes + ids - self.words)

    def step(self, x: np.ndarray, h: np.ndarray, gates: np.ndarray, rh: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """One step for the columns of ``h``, given their words' input columns; fills the gates (z above r), r * h, the candidate and the state."""
        w, n = self.weights, self.hidden
        np.matmul(w["gates"].T, h, out=gates)
        gates += x[: 2 * n]
        _sigmoid(gates)
        np.multiply(gates[n:], h, out=rh)
        np.matmul(w["candidate"].T, rh, out=c)
        c += x[2 * n :]
        np.tanh(c, out=c)
        np.subtract(c, h, out=out)
        out *= gates[:n]
        out += h

    def output(self, h: np.ndarray, ids: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ``ids`` (form classes: of the class alone); with ``slopes`` (empty, or zeros to fill), gradients too."""
        w, classes = self.weights, self.class_of(ids)
        if slopes is not None:
            for k in ("classes", "class_bias", "words", "word_bias"):
                if k not in slopes:
                    slopes[k] = np.zeros_like(w[k])

        room = np.empty(BLOCK * max(self.width, len(w["class_bias"])), h.dtype)

        def softmax(state: np.ndarray, own: np.ndarray, weights: np.ndarray, bias: np.ndarray, made: np.ndarray, back: np.ndarray | None, slope: tuple) -> None:
            """Fill log-probabilities of ``own`` and slopes of the states; a column is a token, so that sums run along the tokens."""
            # logits lie within ``REACH`` of their biases: one shift does for all, and no exponential leaves the range
            far = np.abs(weights).sum(0).max() * most > REACH
            bias = bias if far else bias - bias.max()
            for at in range(0, len(own), BLOCK):
                rows, mine = state[at : at + BLOCK], own[at : at + BLOCK]
                n = np.arange(len(mine))
                chances = np.matmul(weights.T, rows.T, out=room[: len(bias) * len(n)].reshape(len(bias), -1))
                chances += bias[:, None]
                if far:
                    chances -= chances.max(0)
                found = chances[mine, n]
                np.exp(chances, out=chances)
                total = chances.sum(0)
                made[at : at + BLOCK] = found - np.log(total)
                if back is not None:
                    chances *= 1 / total
                    chances[mine, n] -= 1
                    slope[0][:] += rows.T @ chances.T
                    slope[1][:] += chances.sum(1)
                    np.matmul(chances.T, weights.T, out=back[at : at + BLOCK])

        learns, most = slopes is not None, np.abs(h).max(initial=0)
        out, d_h = np.empty(len(ids), h.dtype), np.empty(h.shape, h.dtype) if learns else None
        softmax(h, classes, w["classes"], w["class_bias"], out, d_h, (slopes["classes"], slopes["class_bias"]) if learns else ())
        known = np.flatnonzero(ids < self.words)
        if len(known):
            own = classes[known].astype(np.uint16)
            order = np.argsort(own, kind="stable")
            known, own = known[order], own[order]
            states, inside = h[known], ids[known] % self.width
            made, back = np.empty(len(known), h.dtype), np.empty_like(states) if learns else None
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:], strict=False):
                k = own[a]
                softmax(
                    states[a:b], inside[a:b], w["words"][k], w["word_bias"][k], made[a:b],
                    back[a:b] if learns else None, (slopes["words"][k], slopes["word_bias"][k]) if learns else (),
                )
            out[known] += made
            if learns:
                d_h[known] += back
        return out, d_h


def lanes_of(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deal documents over lanes, longest first to the shortest lane.

    Returns the lanes end to end (inputs, ids, document numbers) and each lane's first
    position and length, by falling length.  An input of -1 begins a document.
    """
    heap = [(0, lane, []) for lane in range(max(1, min(n, len(docs))))]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, lane, held = heapq.heappop(heap)
        held.append(d)
        heapq.heappush(heap, (size + len(docs[d]), lane, held))
    lanes = sorted(heap, key=lambda x: -x[0])
    order = [d for _, _, held in lanes for d in held]
    ids = np.concatenate([docs[d] for d in order])
    number = np.repeat(order, [len(docs[d]) for d in order])
    inputs = np.empty_like(ids)
    inputs[1:] = ids[:-1]
    inputs[np.cumsum([0] + [len(docs[d]) for d in order[:-1]])] = -1
    length = np.array([x[0] for x in lanes])
    return inputs, ids, number, np.cumsum(length) - length, length


def log_likelihoods(net: Network, docs: list[np.ndarray], begin: int) -> np.ndarray:
    """Natural log-likelihood of each document (ids that end with the end token); the state crosses windows."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    inputs, ids, number, first, length = lanes_of(docs, LANES)
    n, inputs_of = net.hidden, net.weights["inputs"]
    h = np.zeros((n, len(length)), inputs_of.dtype)
    for at in range(0, int(length[0]), WINDOW):
        states, where = [], []
        for t in range(at, min(at + WINDOW, int(length[0]))):
            k = int(np.searchsorted(-length, -t, side="left"))
            spot = first[:k] + t
            read, h = inputs[spot], h[:, :k]
            new = read < 0
            if new.any():
                h = np.where(new, h.dtype.type(0), h)
                read = np.where(new, begin, read)
            gates, made = np.empty((2 * n, k), h.dtype), np.empty((3, n, k), h.dtype)
            net.step(np.ascontiguousarray(inputs_of[read].T), h, gates, *made)
            h = made[2]
            states.append(h)
            where.append(spot)
        where = np.concatenate(where)
        made, _ = net.output(np.concatenate(states, axis=1).T, ids[where])
        out += np.bincount(number[where], made, len(docs))
    return out


class Adam:
    """Adam over weights that lie end to end: ``slopes`` are views to fill, and a step works in place in parts that fit a cache."""

    PART = 1 << 14

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.steps = rate, 0
        self.flat = np.concatenate([v.ravel() for v in weights.values()])
        self.slope, self.first, self.second = (np.zeros_like(self.flat) for _ in range(3))
        self.slopes, at = {}, 0
        for k, v in weights.items():
            self.slopes[k] = self.slope[at : at + v.size].reshape(v.shape)
            weights[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.spare = np.empty(self.PART, "f4")

    def step(self, words: int) -> None:
        """Move the weights by the mean slope over ``words``, each clipped to 1; the slopes are zeros again.

        The moments' start from zero is made up for in the rate and in the floor below the root.
        """
        self.steps += 1
        root = (1 - 0.99**self.steps) ** 0.5
        rate, least = self.rate * root / (1 - 0.9**self.steps), 1e-6 * root
        for at in range(0, len(self.flat), self.PART):
            w, g, m, v = (x[at : at + self.PART] for x in (self.flat, self.slope, self.first, self.second))
            a = self.spare[: len(w)]
            if max(float(g.max()), -float(g.min())) > words:
                np.minimum(np.maximum(g, -words, out=g), words, out=g)
            g *= 0.1 / words
            m *= 0.9
            m += g
            g *= g
            v *= 0.99
            v += g
            np.sqrt(v, out=a)
            a += least
            np.divide(m, a, out=a)
            a *= rate
            w -= a
            g.fill(0)


def train(net: Network, docs: list[np.ndarray], begin: int, rate: float = RATE, preceding: list[int] | None = None) -> Network:
    """One pass of truncated backpropagation through time, with Adam.

    The documents lie end to end and are cut into lanes of equal length, of which more go abreast where there
    are more words (the rate grows with their root); a lane that begins inside a document begins with the word before and an empty state.  ``preceding`` has
    -1 for a document's begin and -2 - id for a piece of one whose last word was id.
    """
    if not docs:
        return net
    ids = np.concatenate(docs).astype(np.int32)
    reads = np.empty_like(ids)
    reads[1:] = ids[:-1]
    starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
    fresh = np.zeros(len(ids), bool)
    fresh[starts] = True
    known = np.full(len(docs), -1) if preceding is None else np.array(preceding)
    reads[starts] = np.where(known == -1, begin, -2 - known)
    lanes = min(max(len(ids) // (TRAIN_WINDOW * TRAIN_STEPS), FEW_LANES), TRAIN_LANES, len(ids))
    first = np.linspace(0, len(ids), lanes + 1).astype(np.int64)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    first, length = first[:-1][order], length[order]
    fresh[first] = True
    w, n = net.weights, net.hidden
    adam = Adam(w, rate * (lanes / FEW_LANES) ** 0.5)
    slopes, kind = adam.slopes, w["gates"].dtype
    h, sums = np.zeros((n, lanes), kind), np.zeros(w["inputs"].shape[::-1], kind)
    for at in range(0, int(length[0]), TRAIN_WINDOW):
        spot = first + np.arange(at, min(at + TRAIN_WINDOW, int(length[0])))[:, None]
        live = (spot < first + length).ravel()
        spot = np.minimum(spot, len(ids) - 1)
        read, keep, steps = reads[spot], ~fresh[spot], len(spot)
        x = np.ascontiguousarray(w["inputs"][read].transpose(0, 2, 1))
        before, rh, c, after = np.empty((4, steps, n, lanes), kind)
        gates = np.empty((steps, 2 * n, lanes), kind)
        for t in range(steps):
            np.multiply(h, keep[t], out=before[t])
            net.step(x[t], before[t], gates[t], rh[t], c[t], after[t])
            h = after[t]
        states, wanted = after.transpose(0, 2, 1).reshape(-1, n), ids[spot].ravel()
        if live.all():
            d_h = net.output(states, wanted, slopes)[1]
        else:
            d_h = np.zeros_like(states)
            d_h[live] = net.output(states[live], wanted[live], slopes)[1]
        d_h = np.ascontiguousarray(d_h.reshape(steps, lanes, n).transpose(0, 2, 1))
        carried = None
        for t in reversed(range(steps)):
            own, z, r, made = d_h[t], gates[t, :n], gates[t, n:], x[t]  # the inputs' room takes their slopes
            if carried is not None:
                own += carried
            shut = 1 - z
            stays = own * shut
            own *= z
            d_z = np.subtract(c[t], before[t], out=made[:n])
            d_z *= own
            d_z *= shut
            d_c = np.multiply(c[t], c[t], out=made[2 * n :])
            np.subtract(1, d_c, out=d_c)
            d_c *= own
            d_rh = w["candidate"] @ d_c
            d_r = np.subtract(1, r, out=made[n : 2 * n])
            d_r *= r
            d_r *= before[t]
            d_r *= d_rh
            carried = w["gates"] @ made[: 2 * n]
            d_rh *= r
            carried += d_rh
            carried += stays
            carried *= keep[t]
            slopes["candidate"] += rh[t] @ d_c.T
            slopes["gates"] += before[t] @ made[: 2 * n].T
        # a row of sums for each input column fits a cache, and all columns share the places
        sums.fill(0)
        places = read.ravel().astype(np.intp)
        for column in range(3 * n):
            np.add.at(sums[column], places, x[:, column].ravel())
        slopes["inputs"] += sums.T
        adam.step(int(live.sum()))
    return net


# --- the operator --------------------------------------------------------------------------------

@dataclass
class Model:
    """The network with the corpus counts it scores by."""

    net: Network
    local: dict[bytes, int]
    counts: np.ndarray
    least: int
    total: int
    distinct: int
    form_totals: np.ndarray
    form_distinct: np.ndarray

    def base_floor(self) -> float:
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))

    def form_floor(self) -> np.ndarray:
        return np.log10(self.form_totals + SMOOTH * (self.form_distinct + 1))


def local_floor(counts: DataFrame, most: int) -> int:
    """The least count whose words, with all commoner ones, are at most ``most``.

    Counts are gathered in buckets: exact below 4096, 1024 a doubling above, so the
    driver gets a bounded histogram and never candidates of every partition.
    """
    n = F.col("n")
    bucket = F.when(n < 4096, n).otherwise(F.lit(4096) + F.floor((F.log2(n) - 12) * 1024)).cast("long")
    rows = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("words"), F.min("n").alias("low")).toPandas()
    rows = rows.sort_values("bucket", ascending=False)
    held = rows.loc[rows["words"].cumsum() <= most, "low"]
    return int(held.iloc[-1]) if len(held) else 1 << 62


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows of ``docs``, and their whole count table (word, n)."""
    training = docs.select(F.col("doc_id").cast("long"), "text").where(id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) != 0)
    counts = cut(word_counts(training))
    least = local_floor(counts, LOCAL_WORDS)
    top = counts.where(F.col("n") >= least).toPandas()
    top["word"] = [bytes(w) for w in top["word"]]
    top = top.sort_values(["n", "word"], ascending=[False, True])
    words, n = top["word"].tolist(), top["n"].to_numpy(np.int64)
    soft = min(SOFTMAX_WORDS, len(words))
    form = F.crc32(F.substring("word", -3, 3)) % FORM_CLASSES
    totals = counts.groupBy(form.alias("form")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    form_totals, form_distinct = np.zeros(FORM_CLASSES), np.zeros(FORM_CLASSES)
    form_totals[totals["form"].to_numpy(int)], form_distinct[totals["form"].to_numpy(int)] = totals["n"], totals["v"]
    total, distinct = int(form_totals.sum()), int(form_distinct.sum())
    for word, k in zip(words[:soft], n[:soft], strict=True):
        form_totals[form_class(word)] -= k
        form_distinct[form_class(word)] -= 1
    net = Network.start(n[:soft].astype(float), form_totals)
    model = Model(net, {w: i for i, w in enumerate(words)}, n, least, total, distinct, form_totals, form_distinct)

    learn(model, training.select(F.xxhash64("doc_id", "text").alias("place"), "text"))
    return model, counts


def pieces(docs: DataFrame, model: Model) -> DataFrame:
    """(place, n, preceding, ids) of the pieces of every text of ``docs`` (place, text); ``preceding`` as in ``train``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader_of_many(shipped.value)
        for batch in slices(batches):
            ids, ends = read(batch.column(1))[:2]
            ids, size = ids.astype("<i4"), np.diff(ends, prepend=-1)
            many = -(-size // PIECE_WORDS)  # pieces of each text
            n = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first = np.repeat(ends + 1 - size, many) + n * PIECE_WORDS
            stop = np.minimum(first + PIECE_WORDS, np.repeat(ends + 1, many))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), many), pa.int64()), pa.array(n, pa.int64()),
                    pa.array(np.where(n > 0, -2 - ids[first - 1], -1), pa.int32()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()),
                ],
                names=["place", "n", "preceding", "ids"],
            )

    return docs.select("place", F.col("text").cast("binary")).mapInArrow(split, "place long, n long, preceding int, ids binary")


def summed(made: DataFrame, groups: int) -> tuple[np.ndarray, int]:
    """(the sum of the weights times their words, the words) of rows (part, words, weights); tasks add up ``FAN_IN`` each, so the driver gets ``FAN_IN`` at most."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        words = int(frame["words"].sum())
        mean = sum(n * np.frombuffer(w, "<f4").astype(float) for n, w in zip(frame["words"], frame["weights"], strict=True)) / max(words, 1)
        return pd.DataFrame({"part": frame["part"].iloc[:1] // FAN_IN, "words": [words], "weights": [mean.astype("<f4").tobytes()]})

    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        made = made.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(add, "part long, words long, weights binary")
    rows = sorted(made.toLocalIterator(), key=lambda row: row["part"])
    return sum((row["words"] * np.frombuffer(row["weights"], "<f4").astype(float) for row in rows), np.zeros(1)), sum(row["words"] for row in rows)


def learn(model: Model, docs: DataFrame) -> None:
    """Train the network of ``model`` on every text of ``docs`` (place, text), by tasks whose weights are averaged."""
    context = docs.sparkSession.sparkContext
    held = cut(pieces(docs, model))
    words = (held.agg(F.sum(F.length("ids")).alias("bytes")).first()["bytes"] or 0) // 4
    rounds = min(TRAIN_ROUNDS, -(-words // TASK_WORDS))
    groups = -(-words // (rounds * TASK_WORDS)) if rounds else 0
    begin, net = begin_id(model), model.net
    dealt = held.withColumn("part", F.pmod(F.xxhash64("place", "n"), F.lit(rounds * groups))) if rounds else held
    for turn in range(rounds):
        shipped = context.broadcast(net)

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["place", "n", "ids"])
            own = replace(shipped.value, weights={k: v.copy() for k, v in shipped.value.weights.items()})  # noqa: B023
            texts = [np.frombuffer(x, "<i4") for x in frame["ids"]]
            train(own, texts, begin, preceding=frame["preceding"].tolist())
            made = np.concatenate([v.ravel() for v in own.weights.values()]).astype("<f4")
            return pd.DataFrame({"part": frame["part"].iloc[:1], "words": [sum(map(len, texts))], "weights": [made.tobytes()]})

        made = cut(
            dealt.where(F.col("part") % rounds == turn).repartitionByRange(groups, "part").groupBy("part").applyInPandas(work, "part long, words long, weights binary")
        )
        made, total = summed(made.withColumn("part", F.floor(F.col("part") / rounds)), groups)
        if not total:
            continue
        weights, at = {}, 0
        for k, v in net.weights.items():
            weights[k], at = (made[at : at + v.size] / total).astype("f4").reshape(v.shape), at + v.size
        net = replace(net, weights=weights)
    model.net = net


def begin_id(model: Model) -> int:
    at = model.local.get(END, len(model.counts))
    return at if at < model.net.words else model.net.words + form_class(END)


def reader_of_many(model: Model):
    """A function from texts to (network ids, the end token after each text; where those are; places in the local table or -1; the words without a place)."""
    soft, begin, end = model.net.words, begin_id(model), model.local.get(END, -1)
    known = pa.array(list(model.local), pa.binary())
    # a local word beyond the softmax stands for its form class
    forms = np.array([n if n < soft else soft + form_class(w) for w, n in model.local.items()] or [0], np.int32)

    def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
        words, n = words_by_text(texts)
        ends = np.cumsum(n + 1) - 1
        inside = np.ones(len(words) + len(n), bool)
        inside[ends] = False
        found = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        far = np.flatnonzero(found < 0)
        rare = words.take(pa.array(far)).dictionary_encode()
        own = forms[np.maximum(found, 0)]
        own[far] = np.array([soft + form_class(w) for w in rare.dictionary.to_pylist()] or [0], np.int32)[rare.indices.to_numpy()]
        ids, place = np.full(len(inside), begin, np.int32), np.full(len(inside), end, np.int32)
        ids[inside], place[inside] = own, found
        return ids, ends, place, rare

    return read


def reader(model: Model):
    """A function from a text to (network ids, places in the local table or -1, words); the end token comes last."""
    many = reader_of_many(model)

    def read(text: bytes | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        ids, _, place, _ = many(pa.array([text], pa.binary()))
        return ids, place, [*words_of(text), END]

    return read


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    soft = model.net.words

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        read, begin = reader_of_many(made), begin_id(made)
        form_floor, base_floor = made.form_floor(), made.base_floor()
        log_counts = np.log10(made.counts + SMOOTH)
        local_forms = np.array([form_class(w) for w in made.local], int)
        form_terms = np.where(np.arange(len(log_counts)) < soft, 0.0, log_counts - form_floor[local_forms])
        # a place of -1 is the last one
        log_counts, form_terms = np.append(log_counts, 0.0), np.append(form_terms, 0.0)
        end_is_far = END not in made.local
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for batch in slices(batches):
            ids, ends, place, rare = read(batch.column(1))
            many, size = batch.num_rows, np.diff(ends, prepend=-1)
            number = np.repeat(np.arange(many), size)
            known = np.bincount(number, place >= 0, many).astype(np.int64)
            base = np.bincount(number, log_counts[place], many) - base_floor * known
            network = log_likelihoods(made.net, np.split(ids, ends[:-1] + 1), begin) / np.log(10)
            full = np.bincount(number, form_terms[place], many) + network
            # a key no word can have, so that rows spread evenly and match nothing
            keys = [b" " + at.to_bytes(8, "little") for at in range(row, row + many)]
            far = place < 0
            far[ends] = False
            distinct = max(1, len(rare.dictionary))
            pairs, times = np.unique(number[far] * distinct + rare.indices.to_numpy(), return_counts=True)
            words, of = [rare.dictionary.take(pa.array(pairs % distinct))], [row + pairs // distinct]
            if end_is_far:
                words, of, times = [*words, pa.array([END] * many, pa.binary())], [*of, row + np.arange(many)], np.append(times, np.ones(many, int))
            of, none = np.concatenate(of), np.zeros(len(times))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(keys, pa.binary()), *words]), pa.array(np.append(row + np.arange(many), of), pa.int64()),
                    pa.concat_arrays([batch.column(0), pa.nulls(len(times), pa.int64())]), pa.array(np.append(size, times), pa.int64()),
                    pa.array(np.append(known, none.astype(int)), pa.int64()), pa.array(np.append(base, none)), pa.array(np.append(full, none)),
                ],
                names=["word", "row", "doc_id", "times", "known", "base", "full"],
            )
            row += many

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        read_all, "word binary, row long, doc_id long, times long, known long, base double, full double"
    )
    # the words that travel with the tasks need no join
    rest = counts.where(F.col("n") < model.least)
    joined = parts.join(rest, "word", "left")
    is_head = F.startswith("word", F.lit(b" "))
    c = F.coalesce("n", F.lit(0)).cast("double") + SMOOTH
    floors = F.array(*[F.lit(float(x)) for x in model.form_floor()])
    form = (F.crc32(F.substring("word", -3, 3)) % FORM_CLASSES + 1).cast("int")
    terms = joined.select(
        "row", F.when(is_head, F.col("doc_id")).alias("doc_id"), is_head.alias("head"),
        F.when(is_head, F.col("times")).otherwise(F.lit(0)).alias("n_tokens"),
        F.when(is_head, F.col("known")).when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0)).alias("n_known"),
        F.when(is_head, F.col("base")).otherwise(F.col("times") * (F.log10(c) - F.lit(model.base_floor()))).alias("base"),
        F.when(is_head, F.col("full")).otherwise(F.col("times") * (F.log10(c) - F.element_at(floors, form))).alias("full"),
    )
    return (
        terms.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"), F.sum("full").alias("score"),
        )
        .select(
            "doc_id", (id_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == 0).alias("held_out"), "n_tokens", "n_known",
            F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
