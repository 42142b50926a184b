"""Near-duplicates, toxicity, language model and HTML labeller against brute force and held-out accuracy; the pipeline."""

import collections
import math
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import htmltext, lmscore, neardup, toxicity
from engram.llm.common import numbered_ids

DOC = "doc_id long, text string, kept string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)


# --- near-duplicates

def exact_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 75 * len(x | y):
                        p, q = top(a), top(b)
                        parent[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}, sets


def made_documents(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows, n = [], 0
    for size in (1, 1, 2, 3, 40, 8):
        base = [word() for _ in range(60)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    shared = [word() for _ in range(20)]
    for _ in range(40):
        rows.append((n, " ".join(shared + [word() for _ in range(r.choice([1, 3, 10, 40]))])))
        n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = made_documents(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "three short words"), (1004, "Three SHORT words"), (1005, "five words make one shingle")]
    rows += [(1006, "x " * 50_000), (1007, "x " * 40_000), (1003, "three short words")]
    want, sets = exact_components(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g.component_id == want[g.doc_id] and g.n_shingles == len(sets[g.doc_id][0]) and g.kept == (g.doc_id == want[g.doc_id])


def test_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    got = neardup.near_duplicates(frame(spark, [(None, text), (7, text), (None, "other words stand here alone now"), (8, "")])).collect()
    assert sorted((str(g.doc_id), str(g.component_id)) for g in got) == [("7", "7"), ("8", "8"), ("None", "7"), ("None", "None")]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT_ROWS", 8)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 64)
    rows = made_documents(5)
    want, _ = exact_components(rows)
    assert {g.doc_id: g.component_id for g in neardup.near_duplicates(frame(spark, rows)).collect()} == want


# --- toxicity

def test_chain_marginals_brute_force():
    rng = np.random.default_rng(0)
    moves, starts = np.array([[2.0, 0.3], [0.5, 1.5]]), 0.4
    lengths = np.array([6, 4, 1])
    odds = np.zeros((6, 3))
    for n, size in enumerate(lengths):
        odds[:size, n] = rng.uniform(0.05, 4, size)
    got, *_ = toxicity.chain_marginals(odds, lengths, moves, starts)
    for n, size in enumerate(lengths):
        total, toxic = 0.0, np.zeros(size)
        for bits in range(2**size):
            y = [(bits >> t) & 1 for t in range(size)]
            weight = starts if y[0] else 1.0
            for t in range(size):
                weight *= odds[t, n] if y[t] else 1
                weight *= moves[y[t - 1], y[t]] if t else 1
            total += weight
            toxic += weight * np.array(y)
        assert np.allclose(got[:size, n], toxic / total)


def test_toxicity_learns_and_tags(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghijk", k=r.randint(2, 6)))
    rows, labels = [], []
    for n in range(600):
        toxic = n % 4 == 0
        words = [word() for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["grubnak", "grubnaker", "zzfoul"]))
        rows.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    docs = frame(spark, rows + [(900, None), (901, ""), (902, "é grubnak, " + "b " * 100_000), (None, "abc")])
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {g.doc_id: g for g in toxicity.tag(docs, chain).collect()}
    held = [n for n in range(600) if zlib.crc32(str(n).encode()) % 5 == 0]
    assert sum(got[n].predicted == (n % 4 == 0) for n in held) >= 0.97 * len(held)
    assert got[900].score == got[901].score < 0.5 and all(0 <= g.score <= 1 for g in got.values())
    span = got[902].spans[0]
    assert ("é grubnak, ")[span.start : span.start + span.length] == "grubnak,"
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(g.predicted == 0 for g in got.values())
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {g.score for g in toxicity.tag(docs.limit(5), none).collect()} == {0.0}
    assert toxicity.tag(docs.limit(0), chain).count() == 0


# --- language model

def test_base_scores_are_exact_and_the_network_helps(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "LOCAL_WORDS", 200)
    r = random.Random(4)
    vocab = [["a%d" % n for n in range(60)], ["b%d" % n for n in range(60)]]
    rows = [(n, " ".join(r.choice(vocab[n % 2]) if r.random() < 0.9 else f"rare{r.randrange(400)}" for _ in range(r.randint(0, 80)))) for n in range(400)]
    rows += [(500, None), (501, ""), (502, "Only UNSEEN wörds"), (503, "a1 " * 30_000), (None, "a1 a2")]
    df = frame(spark, rows)
    got = lmscore.score(df, *lmscore.fit(df)).collect()
    counts = collections.Counter()
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, w in words:
        if not held(i):
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    by = {g.doc_id: g for g in got}
    assert len(got) == len(rows)
    for i, w in words:
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        g = by[i]
        assert math.isclose(g.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(w), sum(counts[x] > 0 for x in w), total, held(i))
    out = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 400]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_window_borders_do_not_change_scores(monkeypatch):
    net = lmscore.Network.start(np.arange(50, 0, -1).astype(float), np.ones(lmscore.FORM_CLASSES))
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 80, n) for n in (1, 5, 200, 33, 64)]
    whole = lmscore.log_likelihoods(net, docs, 0)
    monkeypatch.setattr(lmscore, "WINDOW", 7)
    monkeypatch.setattr(lmscore, "LANES", 2)
    assert np.allclose(lmscore.log_likelihoods(net, docs, 0), whole, atol=1e-3)


def test_network_learns_from_long_texts_in_many_tasks(spark, monkeypatch):
    r, words = random.Random(8), [f"w{n}" for n in range(40)]

    def text():
        at = r.randrange(40)
        return " ".join(words[(at + n) % 40] for n in range(6000))  # each word tells the next

    df = frame(spark, [(n, text()) for n in range(40)])
    model, counts = lmscore.fit(df)
    rows = df.selectExpr("doc_id AS place", "text")
    parts = {}
    for p in sorted(lmscore.pieces(rows, model).collect(), key=lambda p: (p.place, p.n)):
        ids = np.frombuffer(p.ids, "<i4")
        assert p.preceding == (-2 - parts[p.place][-1] if p.n else -1) and len(ids) <= lmscore.PIECE_WORDS
        parts.setdefault(p.place, []).extend(ids.tolist())
    read = lmscore.reader(model)
    assert all(parts[n] == read(t.encode())[0].tolist() for n, t in rows.collect())
    monkeypatch.setattr(lmscore, "TASK_WORDS", 20_000)
    for made in (model, lmscore.fit(df)[0]):
        held = [g for g in lmscore.score(df, made, counts).collect() if g.held_out]
        assert held and sum(g.score - g.base_score for g in held) > 0.1 * sum(g.n_tokens for g in held)


def test_network_gradient():
    net = lmscore.Network.start(np.arange(20, 0, -1).astype(float), np.ones(4), seed=1)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype("f8")
    h, ids = np.random.default_rng(1).standard_normal((6, net.hidden)) * 0.3, np.array([0, 3, 19, 21, 7, 22])
    slopes = {}
    net.output(h, ids, slopes)
    for k, at in (("classes", (2, 1)), ("words", (3, 1, 0)), ("class_bias", (2,))):
        w, step = net.weights[k], 1e-5
        w[at] += step
        up = net.output(h, ids)[0].sum()
        w[at] -= 2 * step
        down = net.output(h, ids)[0].sum()
        w[at] += step
        assert abs((down - up) / (2 * step) - slopes[k][at]) < 1e-4


def test_lm_without_training_rows(spark):
    held = next(n for n in range(1000) if zlib.crc32(str(n).encode()) % 10 == 0)
    df = frame(spark, [(held, "some words here")])
    g = lmscore.score(df, *lmscore.fit(df)).first()
    assert g.base_score == 0 and g.n_known == 0 and g.train_tokens == 0 and g.n_tokens == 4
    assert lmscore.score(df.limit(0), *lmscore.fit(df)).count() == 0


# --- HTML

def test_custom_and_self_closed_elements_are_not_raw():
    page = "<p>a<svg-icon>b</svg-icon><svg width=1 /></p><title-bar>c</title-bar><p>d</p><svg><text>no</text></svg><title>no</title><svg/><p>e</p>"
    assert "".join(text for text, *_ in htmltext.leaf_blocks(page)) == "abcde"


def test_hostile_pages_stay_small():
    net = htmltext.Labeller()
    for page, n in (("<p>some words here" * 20_000, 20_000), ("<" + "a" * 300_000, 0), ('<div class="x y">t' * 20_000, 20_000), ("<div>x" * 5000 + "</p>" * 50_000, 5000)):
        start = time.time()
        tracemalloc.start()
        found = htmltext.main_texts([page] + ["<p>one</p>"] * 127, net)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found[0][1] == n and found[1][1] == 1 and peak < 500 << 20 and time.time() - start < 60


def test_lstm_against_a_plain_loop_and_its_gradient():
    pages = [htmltext.leaf_blocks(p) for p in ("<main><p>a b<p>c</main><div class=x>d e f</div>", "<p>one", "<ul><li>x<li>y</ul>")]
    net = htmltext.Labeller(3)
    w = {k: v.astype(float) for k, v in net.w.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for page in pages:
        x = []
        for n, block in enumerate(page):
            tokens, path = [], block[1]
            while path is not None:
                tokens, path = [*path.tokens, *tokens], path.around
            words = [htmltext._buckets[t] for t in block[0].split()]
            vector = sum((w["path"][t] for t in tokens), np.zeros(htmltext.PATH_SIZE)) / max(1, len(tokens)) ** 0.5
            x.append(np.concatenate((vector, 2 * np.mean([w["word"][t] for t in words], 0), htmltext._shape(block, n, len(page)))))
        sides = []
        for way, line in (("f", x), ("b", x[::-1])):
            h = c = np.zeros(htmltext.HIDDEN)
            states = []
            for v in line:
                i, f, o, g = np.split(np.concatenate((v, h)) @ w[way] + w[way + "0"], 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                states.append(h)
            sides.append(states if way == "f" else states[::-1])
        want += [float(sigmoid(np.concatenate(s) @ w["out"][:, 0] + w["bias"][0])) for s in zip(*sides)]
    assert np.allclose(net.chances(pages), want, atol=1e-5)

    gold = np.array([1, 0, 1, 1, 0, 1], "f4")
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    loss = lambda: -np.mean(gold * np.log(p := net.chances(pages).astype(float)) + (1 - gold) * np.log(1 - p))
    tape: dict = {}
    slopes = net.slopes(net.chances(pages, tape), gold, tape)
    token = pages[0][0][1].around.tokens[0]
    for name, at in (("path", (token, 3)), ("word", (htmltext._buckets["d"], 1)), ("f", (2, 7)), ("b", (htmltext.PATH_SIZE + 3, 41)), ("f", (-3, 65)), ("b0", (25,)), ("out", (5, 0)), ("bias", (0,))):
        kept = net.w[name][at]
        ends = []
        for step in (1e-2, -1e-2):
            net.w[name][at] = kept + step
            ends.append(loss())
        net.w[name][at] = kept
        assert abs((ends[0] - ends[1]) / 2e-2 - slopes[name][at]) < 2e-4 + 0.03 * abs(slopes[name][at]), name


def test_labeller_on_unseen_layouts():
    labeller = htmltext.trained()
    grammar = htmltext.PageGrammar(77)
    pages = [p for p in (grammar.page() for _ in range(200)) if p[0]]
    p = labeller.chances([b for b, _ in pages]) >= 0.5
    assert (p == np.array([y for _, ys in pages for y in ys])).mean() > 0.98


def test_extract_edge_cases(spark):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First   <b>bold</b>text&nbsp;here.</p><script>var t="</p>";</script><p>Second &#233; paragraph,
with a line.</p></article><section class="comments"><p>Nice post, thanks for it.</p></section><footer>&copy; me</footer>"""
    rows = [(1, None), (2, ""), (3, "<nav></nav>"), (4, page), (4, page), (5, "<article><p>" + "long words. " * 50_000), (6, "<article><p>cut <a href='x")]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    text = {g.page_id: g.text for g in got}
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    assert text[1] == text[2] == text[3] == ""
    assert text[4] == "Title & more\nFirst boldtext here.\nSecond é paragraph, with a line."
    assert text[5] == ("long words. " * 50_000).strip() and text[6] == "cut"
    assert htmltext.extract(df.limit(0)).count() == 0


# --- pipeline

def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in toxicity.tag(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
            assert {r.doc_id for r in out.collect()} == {d for d, p in scored.items() if p == 0}
        if name == "near_duplicates":
            want, _ = exact_components([(r.doc_id, r.text) for r in docs.collect()])
            assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
        if n < len(cp.STAGES) - 1:
            assert out.columns == columns
        docs = out
    assert docs.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_pipeline_keeps_rows_apart_by_more_than_their_ids(spark, sf):
    import corpus_pipeline as cp

    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3
    rows = [(n, base + f"only{n} " * 30, "en", "a", 1) for n in range(4)]
    rows += [(None, base + "only1 " * 30, "en", "a", 1), (None, base + "single " * 30, "en", "a", 1), (None, base + "single " * 29, "en", "a", 1)]
    rows += [(2, base + "only2 " * 30, "en", "a", 1), (9, base + "first " * 30, "en", "a", 1), (9, base + "second " * 40, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row_id", "own_id", "row", "copies", "score", "predicted", "kept", "size"):
        docs = docs.withColumn(name, F.lit("x"))
    kept = cp.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {0: 1, 1: 1, 2: 1, 3: 1, 9: 2, None: 1}
    assert dict(collections.Counter(r.doc_id for r in kept.collect())) == want
    mixed = cp.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)  # one source takes each of its documents once
    assert cp.drop_toxic(spark, docs, sf).columns == docs.columns


def test_null_keys_are_numbered_apart(spark):
    docs = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    single, odd = numbered_ids(docs)
    ids = [r.row_id for r in odd.collect()]
    assert single.count() == 666 and len(set(ids)) == 334 and min(ids) > 999
    top = docs.unionByName(spark.sql("select 9223372036854775807L as doc_id, 'x' as text"))
    assert max(r.row_id for r in numbered_ids(top)[1].collect()) < 0
    assert numbered_ids(docs.where("doc_id is not null"))[1] is None


def test_pipeline_on_odd_rows(spark, sf, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id at all in this row", "en", "a", 9), (3, "w " * 9000, "en", "b", 9)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for n, (name, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}{len(data)}")
            stage(spark, docs, sf).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() > 0 if data else docs.count() == 0
