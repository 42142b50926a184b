"""Steps whose work must not grow with the product of their tables, against plain Python."""

import ast
import random

import numpy as np
from test_legs import DAY, SCOPE, TURN, query, turn

from engram.functions import vectors
from engram.operators import graph, legs, lexical
from engram.operators import lifecycle as lc
from engram.operators import retrieve as rt


def test_newest_rows_with_a_keyword(spark, monkeypatch):
    rng = random.Random(11)
    words = ["cart", "art", "a b", "[x]", "carton", "ärte", "b"]
    turns = [(*turn(rng, n), rng.choice(["", "a cart", "the art of x", "xx a b", "q[x]q", "cartons", "härter", "zzz", "b"])) for n in range(300)]
    queries = [(*query(rng, n), rng.sample(words, rng.randrange(3))) for n in range(30)]
    queries[3] = (*queries[3][:-1], [""])
    for passes in (1, 3):
        if passes > 1:
            monkeypatch.setattr(vectors, "QUERY_BYTES", 2_500)
            monkeypatch.setattr(vectors, "CELLS", 100)
            monkeypatch.setattr(vectors._Keywords, "REMEMBERED", 2)
        rows, asked = spark.createDataFrame(turns, TURN + ", text string").repartition(3), spark.createDataFrame(queries, SCOPE + ", keywords array<string>")
        found = sorted((r.query_id, r.id) for r in vectors.scoped_newest(rows, asked, 4, "id").collect())
        want = []
        for q in queries:
            _, _, mode, t0, t1, _, _, _, own, out, some, unwanted, words_ = q
            met = []
            for n, _, us, c, clusters, decay, archived, private, text in turns:
                clusters = clusters or []
                ok = us is not None and decay is not None and (decay > 0 and not archived if mode == "current" else decay > 0)
                ok = ok and (t0 is None or us >= t0) and (t1 is None or us < t1) and (not private if own is None else c is not None and c in own)
                ok = ok and (out is None or (c is not None and c not in out)) and (some is None or not clusters or any(x in some for x in clusters))
                if ok and not any(x in (unwanted or []) for x in clusters) and (not words_ or any(w in text for w in words_)):
                    met.append((-us, n))
            want += [(q[0], n) for _, n in sorted(met)[:4]]
        assert found == sorted(want) and len(found) > 60


def test_the_cold_store_is_not_paired_with_all_queries(spark):
    cold = spark.createDataFrame(
        [(1, None, 5, 1, False, "an Apple"), (2, None, 2**40 + 5, 1, False, "APPLES"), (3, None, 2**40 + 6, 1, None, "apple"), (4, None, 6, 2, None, "apple"), (5, None, 2**40 + 5, 1, False, None)],
        "id long, vector array<double>, us long, conversation long, is_private boolean, text string",
    )
    asked = spark.createDataFrame(
        [(1, [1.0], "range", 0, 100 * DAY, None, None, ["aPPle", None]), (2, [1.0], "range", 0, 9, [2], None, ["apple"]), (3, [1.0], "range", 0, 100 * DAY, None, None, [None]), (4, [1.0], "range", 0, 100 * DAY, None, [1], None), (5, None, "range", 0, 9, None, None, [])],
        "query_id long, vector array<double>, mode string, t0 long, t1 long, conversations array<long>, excluded array<long>, keywords array<string>",
    )
    found = legs.cold_leg(cold, asked, 1000)
    assert [(r.query_id, r.id, r.distance) for r in found.orderBy("query_id", "rank").collect()] == [(1, 2, 1.0), (1, 1, 1.0), (2, 4, 1.0), (5, 1, 1.0)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_lexical_search_shuffles_no_score_a_document(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join(rng.choice(words[: rng.choice((3, 24))]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    turns, queries = [turn(rng, n) for n in range(390)], [(*query(rng, n), rng.sample(words, rng.randrange(1, 6))) for n in range(40)]
    index = lexical.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/index", range_docs=40, buckets=3)
    asked = spark.createDataFrame(queries, SCOPE + ", terms array<string>")
    terms = asked.selectExpr("query_id", "explode(terms) as term")
    every = {(r.query_id, r.doc_id): r.score for r in lexical.search(index, terms, 1000).collect()}
    want = []
    for q in queries:
        _, _, mode, t0, t1, _, _, _, own, out, some, unwanted, _ = q
        met = []
        for n, _, us, c, clusters, decay, archived, private in turns:
            clusters = clusters or []
            ok = (q[0], n) in every and us is not None and decay is not None and (decay > 0.2 and not archived if mode == "current" else decay > 0)
            ok = ok and (t0 is None or us >= t0) and (t1 is None or us < t1) and (not private if own is None else c is not None and c in own)
            ok = ok and (out is None or (c is not None and c not in out)) and (some is None or not clusters or any(x in some for x in clusters))
            if ok and not any(x in (unwanted or []) for x in clusters):
                met.append((-every[q[0], n], n))
        want += [(q[0], n, rank) for rank, (_, n) in enumerate(sorted(met)[:6], 1)]
    monkeypatch.setattr(lexical, "QUERIES", 7)
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(lexical, "PAIRS", pairs)
        found = lexical.search(index, terms, 6, probes=1, scope=(spark.createDataFrame(turns, TURN), asked))
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found.collect()) == sorted(want) and len(want) > 100
    plain = lexical.search(index, terms, 6)
    assert "Generate explode" not in plain._jdf.queryExecution().executedPlan().toString()
    first = sorted(every, key=lambda x: (x[0], -every[x], x[1]))
    assert sorted((r.query_id, r.doc_id) for r in plain.collect()) == sorted(x for q in range(40) for x in [y for y in first if y[0] == q][:6])


def test_a_query_meets_the_models_as_one_row(spark):
    queries = spark.createDataFrame([(1, ["a", "b"], 2), (2, ["c"], 9), (3, [], 0), (3, ["b"], 1)], "query_id long, tags array<string>, need int")
    models = spark.createDataFrame([("x", ["a"], 0, 2, 0), ("y", ["a", "b"], 0, 1, 1), ("z", ["b"], 0, 5, 2), ("w", [], 1, 5, 3)], "model string, model_tags array<string>, priority int, window int, nth int")
    routed = rt.route_models(queries, models)
    assert sorted((r.query_id, r.model, r.score) for r in routed.collect()) == [(1, "x", 1), (3, "y", 1)]
    assert "NestedLoopJoin BuildRight, Inner, (" not in routed._jdf.queryExecution().executedPlan().toString()


def test_moving_centroids_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    vectors_ = [np.zeros(4), *rng.integers(-3, 4, (120, 4)).astype(float)]
    rows = spark.createDataFrame([(1, n, v.tolist()) for n, v in enumerate(vectors_)], "group long, id long, vector array<double>")
    sums, want = [], []
    for v in vectors_:
        near = [float(s @ v / (np.linalg.norm(s) * np.linalg.norm(v) or 1)) for s in sums]
        best = int(np.argmax(near)) if near else -1
        if best < 0 or near[best] < 0.77:
            sums.append(v.copy())
            best = len(sums) - 1
        else:
            sums[best] += v
        want.append(best)
    assert [r.cluster for r in lc.assign_clusters(rows, 0.77).orderBy("id").collect()] == want and len(sums) > 16


def test_a_long_source_is_parsed_in_parts(monkeypatch):
    source = "x = 1\nclass A:\n    def f(self):\n        return '''\nclass No:\n    pass\n'''\n\n@dec(\n  1)\n@two\ndef g():\n    def h(): pass\r\nasync def k():\n    class In: pass\nif x:\n    class Not: pass\nelse:\n    pass\nclass Z: pass"
    tree = ast.parse(source)
    want = {("m", 1)} | {(f"m.{name}", line) for name, line in [("A", 2), ("A.f", 3), ("g", 12), ("g.h", 13), ("k", 14), ("k.In", 15), ("Z", 20)]}
    assert {n.name for n in ast.walk(tree) if hasattr(n, "name")} == {"A", "f", "g", "h", "k", "In", "Not", "Z"}
    for size in (1, 5, 40, 10_000):
        assert {(s, line) for _, s, _, line in graph.symbols_of("m.py", source, size)} == want
        for broken in (source + "\ndef (", "def (\n" + source, source.replace("class Z", "  class Z"), source + "\n'''\nclass Q: pass\n", source + "\0"):
            assert graph.symbols_of("m.py", broken, size) == [("m.py", "m", "module", 1)]
    longest, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda text: longest.append(len(text)) or parse(text))
    assert len(graph.symbols_of("m.py", "class A:\n    def f(self):\n        return 1\n\n" * 2000, 1000)) == 4001
    assert max(longest) < 1100


def test_a_search_holds_a_bounded_number_of_scores(spark, monkeypatch):
    class Small(vectors._Found):
        def take(self, own, scores, ties=None):
            assert scores.size <= 200
            super().take(own, scores, ties)

    monkeypatch.setattr(vectors, "CELLS", 200)
    monkeypatch.setattr(vectors, "_Found", Small)
    rng = np.random.default_rng(4)
    made = rng.integers(-3, 4, (300, 3)).astype(float)
    rows = spark.createDataFrame([(n, v.tolist(), n % 4) for n, v in enumerate(made)], "id long, vector array<double>, g int")
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = []
    for q in range(0, 300, 10):
        near = sorted((-float(made[q] @ made[n]), n) for n in range(300) if n % 4 != q % 4)[:5]
        want += [(q, n, rank) for rank, (_, n) in enumerate(near, 1)]
    found = vectors.block_topk(rows, asked, 5, "id", "vector", group="g", same=False)
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == sorted(want)
