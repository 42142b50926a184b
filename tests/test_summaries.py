"""The incremental fold: several runs make what one makes; failed steps change nothing."""

import random

from engram.operators import summaries


def stepper():
    def step(summary, chunk):  # a closure travels to the workers by value
        return f"{summary}[{chunk.replace(chr(10) * 2, '+')}]"

    return step


fold = stepper()


TURNS = "conversation_id long, turn_id long, us long, text string"


def run(spark, rows, stored, **settings):
    kept = spark.createDataFrame(list(stored.values()), summaries.SCHEMA)
    got = summaries.fold_summaries(spark.createDataFrame(rows, TURNS).repartition(3), kept, settings.pop("fold", fold), 5, 4, **settings)
    return stored | {r["conversation_id"]: tuple(r) for r in got.collect()}


def test_runs_in_parts_equal_one_run(spark):
    r = random.Random(2)
    rows = [(c, n, n // 3, " ".join(["w%d" % n] * r.randrange(0, 4)) if r.random() < 0.95 else None) for c in range(4) for n in range(40)]
    rows += [(9, 0, 0, "short"), (None, 1, 1, "x"), (8, 1, None, "x")]
    whole = run(spark, rows, {}, partial=False)
    stored = {}
    for upto in (7, 8, 23, 40):  # in the middle of chunks, and between turns of one time
        stored = run(spark, [x for x in rows if x[1] < upto], stored, partial=False)
    strip = lambda s: {k: v[:4] for k, v in s.items()}
    assert strip(stored) == strip(whole) and set(whole) == {0, 1, 2, 3}
    text = dict.fromkeys(range(4), "")
    for c in range(4):
        chunk, words = [], 0
        for _, _, _, t in [x for x in rows if x[0] == c]:
            chunk.append(t or "")
            words += len((t or "").split())
            if words >= 4:
                text[c], chunk, words = fold(text[c], "\n\n".join(chunk)), [], 0
    assert {c: whole[c][1] for c in range(4)} == text
    final = run(spark, rows, {}, partial=True)
    assert all(final[c][1].startswith(text[c]) and final[c][3] == 39 for c in range(4))
    assert run(spark, rows, final, partial=True) == final


def test_a_failed_step_keeps_the_old_row(spark):
    rows = [(1, n, n, "one two three four") for n in range(5)] + [(2, n, n, "aa b c d") for n in range(5)]
    old = {1: (1, "kept", 1, 1, 2)}
    got = run(spark, rows, old, fold=lambda s, c: "" if "three" in c and s != "kept" else s + "|")
    assert got[1] == old[1] and got[2][1] == "|||||"
    assert summaries.bounded("w " * 400).count("w") == 250 and summaries.bounded("w " * 290).count("w") == 290
