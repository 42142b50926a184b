"""The inverted index against a full scan."""

import random

import pytest

from engram.operators import lexical
from engram.operators import retrieve as rt


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdef") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rows = [(n, " ".join(r.choice(words[: r.choice((5, 60))]) for _ in range(r.randrange(1, 40)))) for n in range(500)] + [(500, None), (501, ""), (502, "12 34")]
    asked = [(q, r.choice(words)) for q in range(25) for _ in range(r.randrange(1, 6))] + [(99, "zzz"), (98, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(asked, "query_id long, term string").cache()


def test_search_equals_a_full_scan(spark, texts, tmp_path):
    docs, asked = texts
    index = lexical.build(docs, f"{tmp_path}/index", range_docs=30, buckets=5)
    want = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in rt.bm25(docs, asked, 7).collect())
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(index, asked, 7, probes=1).collect())
    assert got == want and len(got) > 100
    bound = index.read("postings").selectExpr("max(size(docs)) as n").first()["n"]
    assert bound <= 60


def test_every_term(spark, texts, tmp_path):
    docs, asked = texts
    index = lexical.build(docs, f"{tmp_path}/index", range_docs=50, buckets=3)
    own = {}
    for r in asked.dropna().distinct().collect():
        own.setdefault(r["query_id"], set()).add(r["term"])
    split = {r["doc_id"]: set((r["text"] or "").split()) for r in docs.collect()}
    want = {(q, d) for q, terms in own.items() for d, words in split.items() if terms <= words}
    assert {(r["query_id"], r["doc_id"]) for r in lexical.search(index, asked, 1000, every=True).collect()} == want
    some = spark.createDataFrame([(n,) for n in range(10)], "query_id long")
    mixed = {(r["query_id"], r["doc_id"]) for r in lexical.search_or_every(index, asked, 1000, some).collect()}
    assert {x for x in mixed if x[0] < 10} == {x for x in want if x[0] < 10} and {x for x in mixed if x[0] >= 10} >= {x for x in want if x[0] >= 10}
    assert lexical.search(index, asked.limit(0), 5).count() == 0


def test_an_index_serves_later_searches_until_its_folder_is_gone(spark, sf, monkeypatch):
    made = []
    build = lexical.build
    monkeypatch.setattr(lexical, "build", lambda docs, folder: made.append(folder) or build(docs, folder))
    monkeypatch.setattr(lexical, "_BUILT", {})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again = lexical.index_of(docs), lexical.index_of(spark.read.parquet(f"{sf}/documents.parquet"))
    assert made == [first.folder] == [again.folder]
    lexical._BUILT.update(dict.fromkeys(lexical._BUILT, f"{first.folder}-gone"))
    assert lexical.index_of(docs).folder == made[1] != made[0]
