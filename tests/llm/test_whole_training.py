"""The language model learns from every training row."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import lmscore
from engram.llm.common import id_remainder


def test_every_training_row_teaches_the_network(spark, monkeypatch):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 50).alias("text"))
    taught = []
    monkeypatch.setattr(lmscore, "learn", lambda model, docs: taught.append(docs.count()))
    lmscore.fit(docs)
    assert taught == [docs.where(id_remainder(F.col("doc_id"), lmscore.HELD_OUT_MODULUS) != 0).count()]


def test_weights_are_averaged_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN_IN", 3)
    rng = np.random.default_rng(2)
    rows = [(part, int(rng.integers(0, 90)), rng.standard_normal(7).astype("<f4")) for part in range(20)]
    made = spark.createDataFrame([(p, n, bytearray(w.tobytes())) for p, n, w in rows], "part long, words long, weights binary").repartition(6)
    got, total = lmscore.summed(made, 20)
    assert total == sum(n for _, n, _ in rows)
    assert np.allclose(got, sum(n * w.astype(float) for _, n, w in rows), rtol=1e-5, atol=1e-3)


def test_words_of_many_texts_are_those_of_each():
    texts = [None, b"", b" \t\n\x0b\x0c\r ", b"  Two  WORDS\n", "É ß\x1c\x1d\x85 a b".encode(), b"x" * 500 + b"\r\ny", b"bad \xff\xfe Utf"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts, pa.binary())], names=["n", "text"])] * 2
    for most in (1, 40, 10_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(lmscore, "SLICE_BYTES", most)
            parts = list(lmscore.slices(iter(batches)))
        assert [n for p in parts for n in p.column(0).to_pylist()] == [*range(7)] * 2
        at = 0
        for part in parts:
            words, n = lmscore.words_by_text(part.column(1))
            want = [lmscore.words_of(texts[(at + row) % 7]) for row in range(part.num_rows)]
            at += part.num_rows
            assert words.to_pylist() == [w for x in want for w in x] and n.tolist() == [len(x) for x in want]


def test_training_takes_every_word_once_in_few_steps(monkeypatch):
    """Steps of a task grow no faster than its words over all lanes, and no word is left out or taken twice."""
    rng, taken = np.random.default_rng(3), []
    docs = [rng.integers(0, 82, n) for n in (1, 2, 1024, 700, *[1024] * 400)]
    net = lmscore.Network.start(np.arange(50, 0, -1).astype(float), np.ones(lmscore.FORM_CLASSES))
    plain = lmscore.Network.output

    def output(self, h, ids, slopes=None):
        taken.append(ids)
        return plain(self, h, ids, slopes)

    monkeypatch.setattr(lmscore.Network, "output", output)
    lmscore.train(net, docs, 0, preceding=[-1 if n % 3 else -2 - 7 for n in range(len(docs))])
    assert np.array_equal(np.bincount(np.concatenate(taken)), np.bincount(np.concatenate(docs)))
    assert len(taken) <= 2 * lmscore.TRAIN_STEPS


def test_softmax_far_from_its_biases():
    """Logits that spread beyond an exponential's range give finite scores."""
    net = lmscore.Network.start(np.arange(50, 0, -1).astype(float), np.ones(lmscore.FORM_CLASSES))
    net.weights["classes"] += np.linspace(-9, 9, net.weights["classes"].shape[1], dtype="f4")
    ids = np.array([0, 20, 49, 60])
    got, _ = net.output(np.ones((4, net.hidden), "f4"), ids)
    logits = net.weights["classes"].astype(float).sum(0) + net.weights["class_bias"]
    want = logits[net.class_of(ids)] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    assert np.isfinite(got).all() and np.isclose(got[3], want[3], rtol=1e-4)
