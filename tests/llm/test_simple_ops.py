"""Packing, URL rules, media, mixing, chat format and top-k against brute force, with edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from engram.llm import chatformat, media, mixing, packing, topk, urlfilter

DOC = "doc_id long, text string, source string, size string, length int"
ODD = [
    (1, None, None, "x", 1), (2, "", "a", "x", 1), (3, " \t\n", "a", None, None), (4, "word", "a", "x", 1), (5, "word", "b", "x", 1), (5, "word", "b", "x", 1),
    (None, "no id here", "b", "x", 1), (6, "very long " * 30_000, "c", "x", 1), (7, "É ñ ü 漢字 🎉 don't 12½ <|endoftext|>", None, "x", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- packing

def test_pack_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    rows = packing.pack(odd).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for doc_id, text, *_ in ODD:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (str(r[0]), r[1], r[4])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(none).count() == 0


def test_best_fit_is_exact():
    for seed in range(40):
        r = random.Random(seed)
        capacity = r.choice([7, 20, 64])
        histogram = {r.randint(1, capacity): r.randint(1, 30) for _ in range(r.randint(1, 12))}
        _, n = packing.best_fit_plan(histogram, capacity)
        rooms = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fits = [i for i, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= length
                else:
                    rooms.append(capacity - length)
        assert n == len(rooms)


def test_other_tokenizers_encode_whole_texts(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.Encoder(path).by_word
    assert packing.pack(odd.where("doc_id = 4"), tokenizer=path).count() == 1


# --- URL rules

def test_url_parts_and_rules(spark):
    urls = [
        (1, "HTTP://WWW.Example.COM/en/7x?q#f"), (2, "http://a.net/de/1"), (3, "http://b.example.net/de/85"), (4, "x.org/es/1"), (5, None), (6, ""), (7, "http://é.org/es/"),
        (8, "http://com/en/"), (9, "http://notexample.com/en/7"), (10, "a://b?/c/en/"), (11, "http://x.com#/en/"), (12, "http://x.com/EN/"), (12, "http://x.com/EN/"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, labelled).collect()}
    assert got == {
        1: ("www.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("a.net", "/de/1", "net/de/", "block"), 3: ("b.example.net", "/de/85", "example.net/de/8", "block"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("é.org", "/es/", "org/es/", "block"), 8: ("com", "/en/", "com/en/", "block"),
        9: ("notexample.com", "/en/7", "com/en/", "block"), 10: ("b", "", None, "allow"), 11: ("x.com", "", None, "allow"), 12: ("x.com", "/EN/", None, "allow"),
    }
    assert urlfilter.filter_urls(pages, labelled).count() == len(urls)
    assert urlfilter.filter_urls(pages.limit(0), labelled).count() == 0


def test_mined_rules_block(spark):
    rows = [(f"http://bad{n % 3}.casino.xyz/win/{n}", True) for n in range(40)] + [(f"http://good{n % 5}.site.xyz/read/{n}", False) for n in range(200)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://new.casino.xyz/win/9"), (2, "http://good1.site.xyz/read/9"), (3, "http://other.site.xyz/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "allow"}


# --- media

def test_text_media_round_trip(spark, odd, none):
    rows = media.text_media(odd.withColumn("media", F.lit(1)).withColumn("tile", F.lit("x"))).collect()
    assert len(rows) == len(ODD)
    assert media.text_media(none).count() == 0
    for r in rows:
        texts = [t for d, t, *_ in ODD if d == r.doc_id]
        raw = (texts[0] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert media.decode(bytes(r.media)).tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert np.load(__import__("io").BytesIO(bytes(r.tile))).shape == (8, 9)
    assert media.text_media(none).count() == 0


def test_formats_and_resize():
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (13, 17), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode(b"P1\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P2\n2 1\n15\n15 0\n").tolist() == [[255, 0]]
    assert media.decode(b"P4\n2 1\n\x80").tolist() == [[0, 255]]
    fine = np.kron(grey.astype(float), np.ones((8, 9)))  # 104 x 153
    want = fine.reshape(8, 13, 9, 17).mean((1, 3))
    assert np.allclose(media.area_resize(grey, 8, 9), want)
    with pytest.raises(ValueError):
        media.decode(b"P5\n9 9\n255\nxx")


def test_media_tiles_keep_bad_files(spark):
    files = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.zeros((9, 9), "u1")))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    got = {r.id: r.rows for r in media.media_tiles(files).collect()}
    assert got == {1: 9, 2: None, 3: None}


# --- mixing

def waterfill(sizes, weights, cap=3):
    total, fixed = sum(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, f in zip(sizes, fixed) if f)
        w = sum(x for x, f in zip(weights, fixed) if not f)
        target = [cap * s if f else rest * x / w for s, x, f in zip(sizes, weights, fixed)]
        over = [not f and t > cap * s + 1e-9 for t, s, f in zip(target, sizes, fixed)]
        if not any(over):
            return target
        fixed = [f or o for f, o in zip(fixed, over)]


def test_mix_targets_and_words(spark, odd, none):
    r = random.Random(3)
    rows = [(n, " ".join(["w"] * r.choice([0, 1, 2, 5, 30, 200])), r.choice(["b", "a", None, "é", "Z", "a", "a", "a", "a", "a"])) for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=256).collect()
    assert len(got) == 3000 and all(0 <= g.copies <= 3 for g in got)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == name) for name in names]
    want = waterfill(sizes, [(1, 2, 3)[n % 3] for n in range(len(names))])
    for name, target, size in zip(names, want, sizes):
        own = [g for g in got if g.source == name]
        assert abs(own[0].target - target) < 1e-6 and own[0].source_size == size
        assert abs(sum(g.size * g.copies for g in own) - target) <= (2 if len(own) <= 256 else 200)  # one document, where a source has several blocks
    again = mixing.mix(docs.repartition(7), block_rows=256).collect()
    assert sorted((g.doc_id, g.copies) for g in got) == sorted((g.doc_id, g.copies) for g in again)
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0


def test_mix_settles_long_documents_beside_a_hot_source(spark):
    r = random.Random(5)
    rows = [(n, "w " * r.randint(1, 40), "hot") for n in range(3000)]
    rows += [(10_000 + n, "w " * r.randint(50, 400), s) for s in ("small", None) for n in range(600)]
    rows += [(20_000, "w " * 30_000, "hot"), (20_001, "w " * 60_000, "small"), (20_002, "w " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 2, 3), (3, 2, 1), (5, 4, 4)):
        got = mixing.mix(docs, weights=weights, block_rows=700).collect()
        assert sorted(g.doc_id for g in got) == sorted(n for n, *_ in rows)
        for name in ("hot", "small", None):
            own = [g for g in got if g.source == name]
            low = min(g.size for g in own)
            assert abs(sum(g.size * g.copies for g in own) - own[0].target) <= max(2, low), (weights, name)
        again = mixing.mix(docs.repartition(5), weights=weights, block_rows=700).collect()
        assert sorted((g.doc_id, g.copies) for g in got) == sorted((g.doc_id, g.copies) for g in again)


def test_cube_flight_keeps_the_constraints():
    r = random.Random(1)
    sizes, chances = [float(r.randint(1, 500)) for _ in range(400)], [0.3] * 400
    moved = mixing.flight(chances, sizes, 5)
    assert sum(0 < c < 1 for c in moved) <= 2
    assert abs(sum(moved) - sum(chances)) < 1e-6 and abs(sum(c * s for c, s in zip(moved, sizes)) - 0.3 * sum(sizes)) < 1e-4
    equal = mixing.flight([0.5] * 10, [7.0] * 10, 1)
    assert abs(sum(equal) - 5) < 1e-6


def test_cube_keeps_inclusion_probabilities_and_lands_small():
    r = random.Random(2)
    sizes = [float(r.randint(1, 60)) for _ in range(120)]
    chances = [0.2 + 0.005 * n for n in range(120)]
    seen = np.zeros(120)
    for seed in range(1200):
        moved = mixing.flight(chances, sizes, seed)
        still = [n for n, c in enumerate(moved) if 0 < c < 1]
        assert len(still) <= 2 and all(sizes[n] <= 20 for n in still)
        landed = mixing.landing(moved, sizes)
        assert [landed[n] for n in range(120) if n not in still] == [moved[n] for n in range(120) if n not in still]
        assert abs(sum(c * s for c, s in zip(landed, sizes)) - sum(c * s for c, s in zip(chances, sizes))) <= 20
        seen += moved
    assert np.abs(seen / 1200 - chances).max() < 5 * 0.5 / 1200**0.5


def test_mix_over_several_levels(spark):
    r = random.Random(8)
    rows = [(n, "w " * r.randint(1, 9), "hot" if n % 3 else "b") for n in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_rows=32, fan_in=4).collect()
    assert sorted(g.doc_id for g in got) == list(range(4000))
    for name in ("hot", "b"):
        own = [g for g in got if g.source == name]
        assert abs(sum(g.size * g.copies for g in own) - own[0].target) <= 9


# --- chat format

def chat(spark, rows):
    return chatformat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_chat_round_trip(spark):
    evil = ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|x", "<\\\\|im_end|>", "a<|<|b", "", "\n", "%0A<|", "\\"]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(zip(["user", "assistant", "sy\nstem%0A", "<|im_end|>", None, "assistant", "user", "user", "assistant"], evil))]
    rows += [(2, 0, "assistant", None), (2, 1, "assistant", "x" * 100_000), (None, None, None, None), (3, 0, "user", "same"), (3, 0, "user", "same")]
    out = chat(spark, rows).select("conv_id", "formatted", chatformat.read_back(F.col("formatted")).alias("turns"), chatformat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    for conv in (1, 2, 3, None):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss == "".join(t for r, t in want if r == "assistant")
        assert got[conv].formatted.count("<|im_end|>") == len(want)
    assert chat(spark, []).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "in", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"unknown": 1},
    ]
    rows = [(n, json.dumps(r)) for n, r in enumerate(records)] + [(9, "not json"), (10, None)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in sorted(chatformat.canonical_turns(df, "conv_id").collect(), key=lambda r: (r.conv_id, r.turn or 0)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {
        0: [("user", "p"), ("assistant", "r")], 1: [("user", "i"), ("assistant", "o")], 2: [("user", "i\n\nin"), ("assistant", "o")], 3: [("user", "u"), ("assistant", "a")],
        4: [("user", "h"), ("assistant", "g")], 5: [(None, None)], 9: [(None, None)], 10: [(None, None)],
    }
    same = df.limit(1).select(chatformat.json_paths(F.lit('{"b":[{"c":1,"a":"x"}],"a b":2}')).alias("p")).first().p
    assert same == ["a b", "b[].a", "b[].c"]


def test_native_plan_has_no_python(spark, sf):
    for q in (chatformat.query, urlfilter.query):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- top-k

def test_topk_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.integers(-3, 4, (400, 8)) / 256
    rows = [(n, v[n].tolist()) for n in range(400)] + [(400, None), (450, [1.0, None] * 4), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [1.0, 2.0]), (650, []), (3, v[3].tolist()), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    valid = [(i, np.floor(256 * np.array(x))) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = set()
    for q, x in valid:
        if q % 50 == 0:
            near = sorted((-int(x @ y), i) for i, y in valid if i != q and len(y) == len(x))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    got = [tuple(g) for g in topk.exact_topk(df).select("query_id", "rank", "vec_id", "score").collect()]
    assert set(got) == want and len(got) == len(want)
    # many passes, each of one tile or a few
    got = [tuple(g) for g in topk.exact_topk(df, pass_bytes=200).select("query_id", "rank", "vec_id", "score").collect()]
    assert set(got) == want and len(got) == len(want)
    assert topk.exact_topk(df.limit(0)).count() == 0
    assert topk.exact_topk(spark.createDataFrame([Row(vec_id=50, embedding=[1.0])])).count() == 0


def test_topk_many_tiles_and_shards(monkeypatch):
    r = np.random.default_rng(9)
    ids, vectors = np.arange(700) % 690, r.integers(-2, 3, (700, 6)).astype(float)
    queries = np.arange(0, 690, 7)
    tiles = [topk.Best(queries[at : at + 16], vectors[queries[at : at + 16]], 5) for at in range(0, len(queries), 16)]
    for at in range(0, 700, 64):
        for tile in tiles:
            tile.merge(ids[at : at + 64], vectors[at : at + 64])
    found = pd.concat([t.frame() for t in tiles])
    for q in queries:
        want = sorted((-int(vectors[q] @ v), int(i)) for i, v in zip(ids, vectors) if i != q)[:5]
        own = found[found["query_id"] == q]
        assert sorted(zip((-own["score"]).tolist(), own["vec_id"].tolist())) == want
