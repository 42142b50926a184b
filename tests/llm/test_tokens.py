"""Token counts behind the digest cache, and the alignment of two tokenizers, against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from engram.llm import tokenalign, tokencount, words

PARTS = ["a", "b", "é", "\n", " ", "  ", "\t", "\r\n", "\r", " ", "'s", "1", "22", "<|endoftext|>", "<s>", "!", ");", "…", "漢字", "😀", " ", "\x1c", "\x85", "\x00", "the", "Tokens", "aaaaaaaaaaaaa"]


def hostile(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def library(path, special):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = not special
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_words_are_the_text():
    for text in hostile(3000, 1):
        assert "".join(words.runs(text)) == text
        assert all(x[-1:].strip() for x in words.runs(text)[:-1])


def test_counts_of_hostile_texts_are_the_librarys():
    path = tokencount.default_tokenizer()
    ids, texts = library(path, True), hostile(6000, 2)
    counter = words.TokenCounter(path)
    assert [n for at in range(0, len(texts), 100) for n in counter.counts(texts[at : at + 100])] == [len(ids(x)) for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(name):
    import public_tokenizers
    import sentencepiece

    path, texts = public_tokenizers.path(name), hostile(500, 3)
    whole = library(path, True) if name.endswith("json") else sentencepiece.SentencePieceProcessor(model_file=path).encode
    assert words.TokenCounter(path).counts(texts) == [len(whole(x)) for x in texts]


def documents(spark, texts):
    return spark.createDataFrame([(n if n % 5 else None, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, content string")


def test_a_second_run_encodes_what_is_new(spark, tmp_path, monkeypatch):
    texts = ["one two", "one two", None, "", "three " * 3000, "one\ttwo", *["many copies"] * 40]
    ids = library(tokencount.default_tokenizer(), True)
    seen = []
    encode = tokencount.encoded

    def watched(rows, tokenizer):
        seen.append(sorted(r["text"] for r in rows.collect()))
        return encode(rows, tokenizer)

    monkeypatch.setattr(tokencount, "encoded", watched)

    def check(own):
        got = tokencount.token_counts(documents(spark, own), f"{tmp_path}/cache").collect()
        want = Counter((n if n % 5 else None, len((t or "").encode()), len(ids(t or ""))) for n, t in enumerate(own))
        assert Counter(map(tuple, got)) == want

    check(texts)
    assert seen == [sorted({t or "" for t in texts})]
    check([*texts, "four", "four"])
    assert seen[1:] == [["four"]]
    check(texts)
    monkeypatch.setattr(tokencount, "BROADCAST_DIGESTS", 0)
    check(["five", *texts])
    assert seen[2:] == [["five"]]
    cache = tokencount.CountCache(spark, f"{tmp_path}/cache", tokencount.default_tokenizer())
    cache.append(cache.read())  # as two runs that missed the same texts
    check(texts)
    cache.compact()
    assert len(cache._batches()) == 1 and cache.read().count() == len({t or "" for t in texts}) + 2
    check(texts)
    assert len(seen) == 3


def test_another_tokenizer_finds_nothing_stored(spark, tmp_path):
    import public_tokenizers

    docs = documents(spark, ["Ab  cd\n\nef", "Ab cd ef", None])
    folder = f"{tmp_path}/cache"
    assert len({tokencount.tokenizer_version(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}) == 3
    tokencount.token_counts(docs, folder).collect()
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokencount.token_counts(docs, folder, path).collect()
    # white space of any length is the same to this tokenizer, so one text stands for two
    assert sorted(r["n_tokens"] for r in got) == sorted(len(library(path, True)(t)) for t in ("Ab  cd\n\nef", "Ab cd ef", ""))
    assert tokencount.CountCache(spark, folder, path).read().count() == 2
    assert tokencount.token_counts(docs.limit(0), f"{tmp_path}/other").count() == 0


def brute(texts):
    """The contract's columns from tokens of whole texts, pair by pair."""
    import sentencepiece

    a_path, b_path = tokenalign.default_tokenizers()
    encode, model = library(a_path, False), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_bytes, b_bytes = tokenalign.LevelSide(a_path).bytes.tokens, tokenalign.PieceSide(b_path).bytes.tokens
    docs, held = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = encode(" " + (text or "")), model.encode(text or "")
        if not text or b"".join(a_bytes[x] for x in a) != raw or b"".join(b_bytes[x] for x in b) != raw:
            docs.append(None)
            continue
        ends = []
        for ids, sizes in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for x in ids:
                at += len(sizes[x])
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = lambda own: [sum(c < e for c in cuts) for e in own]
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((a, b)):
            for x, g in zip(ids, group(ends[side]), strict=True):
                groups[g][side].append(x)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        held.update(set(links))
        docs.append((len(a), len(b), groups, links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = doc
            shown = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
            out.append((n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def test_alignment_equals_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(tokenalign, "BLOCK_BYTES", 2000)
    texts = hostile(700, 5) + [None, "", " ", "\n", "a▁b", "same text here", "same text here", "\nfoo", "foo\n\n bar ", "x" * 5000, "漢" * 300, " " * 100]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    docs = spark.createDataFrame([(n, t, 7) for n, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(5, "doc_id")
    got = {r["doc_id"]: tuple(r)[1:] for r in tokenalign.align(docs)[0].collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        assert got[n] == want[n], repr(text)


def test_words_that_are_forgotten_are_aligned_again(monkeypatch):
    monkeypatch.setattr(tokenalign, "KEPT_WORDS", 50)
    texts = hostile(600, 8)
    small = tokenalign.Aligner(*tokenalign.default_tokenizers())
    parts = [small.block(texts[at : at + 60]) for at in range(0, 600, 60)]
    monkeypatch.setattr(tokenalign, "KEPT_WORDS", 10**9)
    large = tokenalign.Aligner(*tokenalign.default_tokenizers())
    for at, (columns, pairs) in zip(range(0, 600, 60), parts, strict=True):
        again, all_pairs = large.block(texts[at : at + 60])
        assert [again[c] for c in ("n_a", "n_links", "groups_sha256")] == [columns[c] for c in ("n_a", "n_links", "groups_sha256")]
        assert all((pairs[c] == all_pairs[c]).all() for c in pairs)


def test_pair_counts_and_odd_rows(spark):
    docs = spark.createDataFrame([(None, "word word"), (1, "word"), (1, "word"), (2, None)], "doc_id long, text string")
    rows, counts = tokenalign.align(docs)
    assert sorted((r["doc_id"] or 0, r["n_links"], r["n_best"], r["count_sum"]) for r in rows.collect()) == [(0, 2, 2, 6), (1, 1, 1, 3), (1, 1, 1, 3), (2, 0, 0, 0)]
    assert [(r["count"], r["best"]) for r in counts.collect()] == [(3, True)]
    assert tokenalign.align(docs.limit(0))[0].count() == 0
