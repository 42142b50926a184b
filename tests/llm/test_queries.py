"""Every registered query of the operators on the smallest tables: columns and types of its contract, rows, and its SQL."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from engram.llm import chatformat, lmscore, neardup, registry, toxicity, urlfilter

COLUMNS = {
    "op1_html_lstm": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op2_minhash_neardup": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean"),
    "op3_best_fit_packing": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op4_url_rules": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op5_media_columns": ("documents", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"),
    "op6_gru_lm": ("documents", "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"),
    "op7_toxicity_crf": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op8_cube_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op9_chat_format": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op10_exact_topk": (None, "query_id bigint, rank int, vec_id bigint, score bigint"),
    "op11_token_alignment": ("documents", "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"),
    "op12_token_counts": ("documents", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"),
    "op13_cohort_retention": (None, "state int, segment string, cohort bigint, period bigint, users bigint, users_crc32 bigint, moved bigint, cents bigint"),
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_contract(spark, sf, duck, name):
    table, columns = COLUMNS[name]
    got = registry.QUERIES[name](spark, sf)
    want = [tuple(c.split()) for c in columns.split(", ")]
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][: len(want)] == want
    if name in registry.ORACLES:
        same(got, duck, registry.ORACLES[name])
    rows = got.count()
    assert rows == spark.read.parquet(f"{sf}/{table}.parquet").count() if table else rows > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for table in ("documents", "pages", "labels", "conversations", "embeddings", "clicks", "clients"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    # conversation -1 is there in any case
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "op9_chat_format" else 0)


URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM u),
r(says, domain, prefix) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT page_id, domain || prefix AS rule, says, row_number() OVER (PARTITION BY page_id ORDER BY length(domain || prefix) DESC) AS nth FROM p JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix))
SELECT p.page_id, host, path, rule, says AS stated FROM p LEFT JOIN (SELECT * FROM f WHERE nth = 1) f ON p.page_id = f.page_id"""


def test_hosts_paths_and_stated_rules_by_sql(spark, sf, duck):
    got = registry.QUERIES["op4_url_rules"](spark, sf)
    same(got.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("stated")), duck, URL_SQL)


def test_mined_rules_by_brute_force(spark):
    r = random.Random(3)
    url = lambda: f"http://{r.choice('ab')}.{r.choice('xyz')}.q/{r.choice(('k', 'l'))}/{r.choice(('m', 'n'))}?{r.choice('st')}=1"
    rows = []
    for _ in range(300):
        u = url()
        rows.append((u, ("x.q/k" in u and "s=1" in u) != (r.random() < 0.1)))
    rows += [(None, True), ("no scheme", True), (rows[0][0], None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(n, url()) for n in range(40)] + [(40, None)], "page_id long, url string")
    host, path = urlfilter.url_parts(F.col("url"))
    tokens = lambda df: df.withColumn("t", urlfilter.url_tokens(F.col("url"), host, path)).collect()
    sets = [(frozenset(x.t), x.bad) for x in tokens(labelled) if x.bad is not None and x.t]
    least = max(urlfilter.MIN_COUNT, urlfilter.MIN_SUPPORT * len(sets))

    def blocked(own):
        for n in range(1, len(own) + 1):
            for part in map(frozenset, itertools.combinations(own, n)):
                bad = sum(b for s, b in sets if part <= s)
                if bad >= least and bad / sum(part <= s for s, _ in sets) >= urlfilter.MIN_CONFIDENCE:
                    return True
        return False

    want = {x.page_id: "block" if blocked(x.t) else "allow" for x in tokens(pages)}
    got = {x.page_id: x.verdict for x in urlfilter.filter_urls(pages, labelled, rules=()).collect()}
    assert got == want and len(set(want.values())) == 2


def test_urls_of_any_length_and_repeated(spark):
    long = "http://long.example.xyz/" + "a/" * 50_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, None), (2, None), (None, "http://x.net/de/1")], "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://bad.tld/{n}", True) for n in range(9)], "url string, bad boolean")
    got = sorted((str(g.page_id), g.verdict) for g in urlfilter.filter_urls(pages, labelled).collect())
    assert got == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("2", "allow"), ("None", "block")]


def test_labelled_urls_of_many_words_are_mined_in_seconds(spark):
    """Forty words that always come together are one item: a page with any of them is blocked."""
    long = "http://w.bad.tld/" + "/".join(f"word{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(40))
    labelled = spark.createDataFrame([(long, True)] * 4 + [(f"http://fine{n}.tld/x", False) for n in range(30)], "url string, bad boolean")
    pages = spark.createDataFrame([(1, long), (2, "http://else.org/wordab"), (3, "http://else.org/x"), (4, "http://fine3.tld/wordaa/y")] + [(5, long)] * 30, "page_id long, url string")
    got = {(g.page_id, g.verdict) for g in urlfilter.filter_urls(pages, labelled, rules=()).collect()}
    assert got == {(1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "block")}


def test_a_label_that_equals_a_token_is_not_folded(spark):
    labelled = spark.createDataFrame([("http://a.bad.tld/k", True)] * 6 + [("http://b.fine.tld/k", False)] * 6, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://z.bad.tld/q"), (2, "http://z.fine.tld/k")], "page_id long, url string")
    assert {(g.page_id, g.verdict) for g in urlfilter.filter_urls(pages, labelled, rules=()).collect()} == {(1, "block"), (2, "allow")}


def test_lists_of_many_tasks_merge_as_a_tree(spark, monkeypatch):
    from engram.llm import topk

    r = random.Random(9)
    rows = [(n, [float(r.randrange(3)) / 256 for _ in range(4)]) for n in range(400)] + [(7, [0.5] * 3), (50, [0.5] * 3), (9, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(23)
    monkeypatch.setattr(topk, "parallelism", lambda _: 12)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = [tuple(x) for x in con.execute(topk.ORACLE_SQL + " AND query_id <> 50 ORDER BY query_id, rank").fetchall()]
    for settings in ({}, {"fan_in": 2}, {"fan_in": 3, "pass_bytes": 150}):
        got = topk.exact_topk(vectors, **settings).where("query_id <> 50").orderBy("query_id", "rank")
        assert [tuple(x) for x in got.collect()] == want


def test_equal_rows_without_ids_are_dealt_over_blocks(spark, monkeypatch):
    from engram.llm import mixing

    monkeypatch.setattr(mixing, "COPY_RUN", 100)
    rows = [(None, "a b c", "s")] * 1500 + [(n, "a b", "t") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mixing.numbered_copies(docs.select("doc_id", "source", F.length("text").alias("size")))
    assert copies.where("source = 's'").select("copy").distinct().count() == 1500 and copies.count() == 1900
    mixed = mixing.mix(docs, block_rows=64)
    assert mixed.count() == 1900
    taken = {r["source"]: (r["n"], r["t"]) for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t")).collect()}
    assert all(abs(n - t) <= 3 for n, t in taken.values())


def test_rows_of_one_labelled_id_train_once(spark):
    docs = spark.createDataFrame([(1, f"vile word{n}") for n in range(3000)] + [(n, "fine words here") for n in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(n, 0) for n in range(2, 60)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    once = toxicity.fit(docs.where("doc_id <> 1").unionByName(docs.where("doc_id = 1").orderBy(F.crc32(F.col("text").cast("binary"))).limit(1)), labels)
    assert chain.dumps() == once.dumps()


def test_gru_against_a_plain_loop():
    net = lmscore.Network.start(np.arange(90, 0, -1).astype(float), np.arange(1, lmscore.FORM_CLASSES + 1).astype(float), seed=2)
    rng = np.random.default_rng(5)
    w = {k: rng.normal(v, 0.2).astype("f8") for k, v in net.weights.items()}
    net.weights = w
    docs = [rng.integers(0, 90 + lmscore.FORM_CLASSES, n) for n in (1, 7, 40)]
    sigmoid, n = lambda x: 1 / (1 + np.exp(-x)), net.hidden
    want = []
    for doc in docs:
        h, before, total = np.zeros(n), 3, 0.0
        for word in doc.tolist():
            x = w["inputs"][before]
            z, r = np.split(sigmoid(x[: 2 * n] + h @ w["gates"]), 2)
            h = (1 - z) * h + z * np.tanh(x[2 * n :] + (r * h) @ w["candidate"])
            softmax = lambda y: np.exp(y) / np.exp(y).sum()
            k = word // net.width if word < net.words else net.word_classes + word - net.words
            total += np.log(softmax(h @ w["classes"] + w["class_bias"])[k])
            if word < net.words:
                total += np.log(softmax(h @ w["words"][k] + w["word_bias"][k])[word % net.width])
            before = word
        want.append(total)
    assert np.allclose(lmscore.log_likelihoods(net, docs, 3), want, atol=1e-3)


def test_scored_rows_with_null_and_repeated_texts(spark):
    rows = [(n, None if n % 3 else "a b c", "x") for n in range(60)] + [(1, None, "x"), (1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lmscore.score(docs, *lmscore.fit(docs)).collect()
    assert len(got) == len(rows) and all(g.n_tokens == (1 if g.doc_id % 3 else 4) for g in got)


def test_labels_null_repeated_and_conflicting(spark):
    docs = spark.createDataFrame([(n, f"fine words number{n % 7} here" if n % 2 else "vilest vilest words here", "s", 1) for n in range(200)] + [(1, "fine words", "s", 1)] * 2, "doc_id long, text string, predicted string, _predicted int")
    labels = [(n, n % 2 == 0 and 1 or 0) for n in range(200)]
    labels += [(3, 1), (3, 0), (3, None), (None, 1), (9999, 1), *labels[:20]]
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.tag(docs, chain).collect()
    assert len(scored) == 202 and all(g.predicted == 1 - g.doc_id % 2 for g in scored)
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns and kept.count() == 102
    assert toxicity.Chain.loads(chain.dumps()).document.tolist() == chain.document.tolist()
    none = toxicity.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {g.score for g in toxicity.tag(docs, none).collect()} == {0.0}
    assert toxicity.tag(docs.limit(0), chain).count() == 0


def test_document_scores_by_hand():
    odds = np.array([0.1, 3.0, 0.2, 0.5])
    chain = toxicity.Chain(np.zeros(toxicity.FEATURES), np.array([[2.0, 0.5], [0.7, 1.5]]), 0.8, np.array([0.3, 0.9, -0.4]))
    marginals = chain.marginals(odds, np.array([3, 0, 1]))
    weight = {}
    for path in itertools.product((0, 1), repeat=3):
        p = 0.8 ** path[0]
        for t, label in enumerate(path):
            p *= odds[t] ** label * (chain.moves[path[t - 1], label] if t else 1)
        weight[path] = p
    exact = [sum(p for path, p in weight.items() if path[t]) / sum(weight.values()) for t in range(3)] + [0.4 / 1.4]
    assert np.allclose(marginals, exact)
    top, total = max(exact[:3]), sum(exact[:3])
    want = 1 / (1 + np.exp(-(0.3 + 0.9 * np.log(top / (1 - top)) - 0.4 * np.log(total + 1e-2))))
    assert np.isclose(chain.scores(marginals, np.array([3, 0, 1]))[0], want)


def test_chats_with_other_columns_and_long_turns(spark):
    rows = [(1, 0, "user", "x " * 200_000, 5), (1, 1, "assistant", "<|im_end|>", 5), (1, 1, "assistant", None, 5)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").withColumn("formatted", F.lit("clash")).withColumn("place", F.lit(3))
    got = chatformat.format_chats(chats)
    assert got.count() == 1 and len(got.first()["loss_spans"]) == 2 and len(got.first()["formatted"]) > 400_000


def test_large_near_copies_equal_an_exact_join(spark, monkeypatch):
    """A group of 300 near copies with far members, split over blocks and parts, against SQL."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neardup, "SPLIT_ROWS", 16)
    r = random.Random(11)
    base = [f"w{n}" for n in range(120)]
    rows = []
    for n in range(300):
        words = list(base)
        for at in r.sample(range(120), r.choice((0, 1, 2, 3, 4))):
            words[at] = f"other{r.randrange(999)}"
        rows.append((n, " ".join(words)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), con, neardup.ORACLE_SQL)


def test_adam_in_place_against_the_formula():
    import numpy as np

    from engram.llm import lmscore

    rng = np.random.default_rng(1)
    start = {"a": rng.standard_normal((300, 70)).astype("f4"), "b": rng.standard_normal(5).astype("f4")}
    weights = {k: v.copy() for k, v in start.items()}
    adam, want = lmscore.Adam(weights, 0.003), {k: v.astype(float) for k, v in start.items()}
    first, second = ({k: np.zeros(v.shape) for k, v in start.items()} for _ in range(2))
    for step in range(1, 6):
        for k, v in start.items():
            slope = rng.standard_normal(v.shape) * 20
            adam.slopes[k][:] = slope
            slope = np.clip(slope / 16, -1, 1)
            first[k], second[k] = 0.9 * first[k] + 0.1 * slope, 0.99 * second[k] + 0.01 * slope * slope
            want[k] -= 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        adam.step(16)
        assert not any(v.any() for v in adam.slopes.values())
    for k in start:
        assert np.allclose(weights[k], want[k], atol=1e-5)
