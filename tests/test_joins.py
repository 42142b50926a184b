"""Seams of slices and spans of taggers against plain versions."""

import random
import re

from engram.operators import joins


def test_repeated_turns_stay_and_seams_join(spark):
    said = [("user", "Hello there"), ("assistant", "Hi!"), ("user", "ok"), ("assistant", "A long answer, in parts."), ("user", "ok"), ("assistant", "Done, as asked"), ("user", "ok"), ("assistant", "More of it"), ("user", "ok")]
    slices = [said[0:4], said[2:6], said[5:9]]
    slices[0] = [*slices[0][:-1], ("assistant", "A long ans")]  # the cut goes through a turn
    slices[2] = [("assistant", "as asked"), *slices[2][1:]]
    rows = [("t", n, k, role, text, 10_000_000_000) for n, own in enumerate(slices) for k, (role, text) in enumerate(own)]
    rows += [("one", 0, 0, "user", None, 0), ("one", 0, 1, "user", None, 0), ("apart", 0, 0, "user", "a", 0), ("apart", 1, 0, "user", "b", 0)]
    got = joins.joined_at_seams(spark.createDataFrame(rows, "title string, slice int, nth int, role string, text string, mtime_us long")).orderBy("title", "pos").collect()
    assert [(r["role"], r["text"]) for r in got if r["title"] == "t"] == said
    assert [r["us"] for r in got if r["title"] == "t"][-2:] == [10_000_000_000 - 60_000_000, 10_000_000_000]
    assert [r["text"] for r in got if r["title"] == "one"] == ["", ""] and [r["text"] for r in got if r["title"] == "apart"] == ["a", "b"]


def plain_spans(text, spans):
    out = []
    is_word = lambda c: re.fullmatch(r"[^\W_]", c) is not None
    for start, stop, label, score in spans:
        start, stop = max(0, start), min(stop, len(text))
        if start >= stop:
            continue
        while is_word(text[start]) and start > 0 and is_word(text[start - 1]):
            start -= 1
        while is_word(text[stop - 1]) and stop < len(text) and is_word(text[stop]):
            stop += 1
        while start < stop and not is_word(text[start]):
            start += 1
        while start < stop and not is_word(text[stop - 1]):
            stop -= 1
        if start < stop:
            out.append((start, stop, score, label))
    out.sort()
    chains = []
    for s in out:
        if chains and s[0] < max(x[1] for x in chains[-1]):
            chains[-1].append(s)
        else:
            chains.append([s])
    made = []
    for c in chains:
        score, _, label = max((x[2], x[1] - x[0], x[3]) for x in c)
        made.append((min(x[0] for x in c), max(x[1] for x in c), label, score))
    return made


def test_spans_equal_the_plain_version(spark):
    r = random.Random(4)
    texts, spans, want = [(99, None), (98, "")], [(99, 0, 3, "X", 0.5), (98, 0, 1, "X", 0.5), (97, 0, 1, "X", 0.1)], set()
    for n in range(60):
        text = "".join(r.choice("abcDé 7-.,") for _ in range(40))
        own = [(r.randrange(-3, 42), r.randrange(-3, 45), r.choice("PQR"), r.randrange(100) / 100) for _ in range(r.randrange(0, 9))]
        texts.append((n, text))
        spans += [(n, *s) for s in own]
        want |= {(n, *s, text[s[0] : s[1]]) for s in plain_spans(text, own)}
    got = joins.united_spans(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(spans, "id long, start int, stop int, label string, score double"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 40
