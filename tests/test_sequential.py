"""Sequential operators, sources and readers against hand-made cases."""

import io
import json
import zipfile
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import chunking, scalars, timescope
from engram.functions import text as tx
from engram.operators import evaluate, facts, graph, ingest, lifecycle, select
from engram.sources import exports, office, store

NOW = datetime(2026, 7, 10, 12)


@pytest.mark.parametrize(
    "prompt, mode, t0, t1",
    [
        ("what did I say in march 2025?", "as_of", datetime(2025, 2, 15), datetime(2025, 4, 15)),
        ("we met in march 2025", "current", None, None),
        ("what happened on 2026-01-05?", "as_of", datetime(2026, 1, 2), datetime(2026, 1, 9)),
        ("what did we do since 2025?", "range", datetime(2024, 12, 2), NOW),
        ("show Q2 2024", "range", datetime(2024, 3, 11), datetime(2024, 7, 22)),
        ("what did we decide between january 2024 and march 2024?", "range", datetime(2023, 12, 18), datetime(2024, 4, 15)),
        ("how has my plan evolved?", "evolution", None, None),
        ("what about `yesterday`?", "current", None, None),
        ("what do we do in december 2026?", "current", None, None),
        ("remind me what I said 10 days ago", "as_of", datetime(2026, 6, 26, 12), datetime(2026, 7, 4, 12)),
        ("what did I cook last winter?", "range", datetime(2025, 11, 10), datetime(2026, 3, 22)),
        ("spring cleaning, what now?", "current", None, None),
        (None, "current", None, None),
        ("we stopped in. march was fine, what now?", "current", None, None),
        ("what did we do in, march?", "as_of", datetime(2026, 2, 15), datetime(2026, 4, 15)),
        ("compare january 2024 vs march 2024?", "evolution", datetime(2023, 12, 18), datetime(2024, 4, 15)),
        ("what was said before 2024?", "range", datetime(2000, 1, 1), datetime(2023, 12, 2)),
    ],
)
def test_timescope(prompt, mode, t0, t1):
    assert timescope.detect(prompt, NOW)[:3] == (mode, t0, t1)


def test_timescope_evidence():
    got = timescope.detect("how did the plan change over time since 2023", NOW)
    assert got.mode == "evolution" and got.evidence == ("expr:2023", "cue:how did the plan change", "cue:over time", "gate:interrogative")
    assert got.matched == "since 2023; how did the plan change; over time"
    assert timescope.detect("march 2025", NOW, p_ltm=0.6).evidence == ("expr:march 2025", "gate:p_ltm")


def test_chunks_follow_sections_and_carry_words():
    text = "# One\nFirst sentence here. Second sentence here.\n# Two\nThird sentence.\n```\ncode line\n\nother line\n```"
    assert chunking.chunks(text, 10, 2) == ["# One\nFirst sentence here.", "sentence here.\nSecond sentence here.", "# Two\nThird sentence.\n```\ncode line", "code line\nother line\n```"]
    assert chunking.chunks("a" * 100 + " b c", 5, 3) == [*["a" * 20] * 5, "b c"]
    assert chunking.chunks(None) == [] and chunking.chunks(" \n ") == []


def test_timescope_column(spark):
    df = spark.createDataFrame([("what did I say in march 2025?",), (None,)], "p string")
    got = [r.t for r in df.select(timescope.timescope(F.col("p"), NOW).alias("t")).collect()]
    assert got[0].mode == "as_of" and got[0].t0 == 1739577600000000 and got[1].t0 is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n#`x", max_size=300), st.integers(4, 40))
def test_chunks_hold_the_budget_and_lose_no_word(text, budget):
    made = chunking.chunks(text, budget, 2)
    carried = [c for c in made if chunking.quarter(c) > budget + 1]
    # beyond the budget only by the words that a chunk takes over from the one before
    assert all(chunking.quarter(c.split("\n", 1)[-1]) <= budget for c in carried)
    assert all(chunking.quarter(c) <= budget + 1 for c in chunking.chunks(text, budget, 0))
    squeezed = "".join("".join(made).split())
    at = 0
    for letter in "".join(text.replace("```", "").split()):
        found = squeezed.find(letter, at)
        at = found if found >= 0 else at
    assert set("".join(text.split())) - set("`") <= set(squeezed)


def test_chunks_never_cross_a_heading():
    made = chunking.chunks("One. Two.\n# Head\nThree. " + "Long sentence here. " * 40, 50, 5)
    assert made[0] == "One.\nTwo." and made[1].startswith("# Head") and len(made) > 3
    assert chunking.chunks("") == [] and chunking.chunks(None) == []


def test_budget_degrades_before_it_drops():
    f = pd.DataFrame({"id": [1, 2, 3, 4], "leg": ["a", "a", "b", "b"], "score": [9.0, 8.0, 7.0, 1.0], "tokens": [50, 50, 60, 5], "summary_tokens": [None, 20.0, None, None], "abstract_tokens": [None, None, 10.0, None]})
    assert select.pack_budget(f, 100) == [(1, "full", 50), (3, "abstract", 10), (2, "summary", 20), (4, "full", 5)]
    assert select.pack_budget(f, 0) == []


def test_coverage_stops():
    eye = np.eye(4)
    chosen, why = select.cover(eye[0] + eye[1], eye, np.array([4.0, 3, 2, 1]))
    assert chosen == [0, 1] and why in ("knee", "min_gain", "residual_exhausted")
    assert select.knee([0.6, 0.5, 0.01, 0.01], 0.08, 1) == 2 and select.knee([0.1] * 5, 0.08, 2) is None


def test_upsert_rules():
    t = lambda *rows: pd.DataFrame([dict(zip(("relation", "target", "negated", "confidence", "us"), r)) for r in rows])
    out = facts.upsert_subject(t(("lives", 1, False, 0.5, 1), ("lives", 2, False, 0.5, 2)))
    assert out["valid_until"].tolist()[0] == 2 and out["strength"].tolist() == [1.0, 3.0]
    out = facts.upsert_subject(t(("knows", 1, False, 0.5, 1), ("knows", 2, False, 0.5, 2), ("knows", 1, False, 0.9, 3)))
    assert out["valid_until"].isna().all() and out["strength"].tolist() == [2.0, 1.0] and out["state"].tolist() == ["active", "pending"]
    out = facts.upsert_subject(t(("status", 1, False, 0.5, 1), ("status", 2, False, 0.5, 2), ("status", 2, True, 0.5, 3)))
    assert out["negated"].tolist() == [False, False, True] and out["valid_until"].tolist()[:2] == [2, 3]


def test_entity_merge_remaps(spark):
    edges = spark.createDataFrame([(1, 1, 9, "r", 1.0, 0.5, False, 5, None), (2, 2, 9, "r", 2.0, 0.4, False, 3, None), (3, 1, 2, "r", 1.0, 0.5, False, 5, None)],
                                  "edge_id long, source long, target long, relation string, strength double, confidence double, negated boolean, valid_from long, valid_until long")
    got = graph.merge_entities(edges, spark.createDataFrame([(2, 1)], "old long, new long")).collect()
    assert [(r.source, r.target, r.strength, r.confidence, r.valid_from) for r in got] == [(1, 9, 2.0, 0.5, 3)]


def test_fill_times(spark):
    m = 60_000_000
    rows = spark.createDataFrame([("a", 0, None), ("a", 1, 100 * m), ("a", 2, None), ("a", 3, 50 * m), ("b", 0, None), ("b", 1, None)], "conv_id string, pos long, us long")
    got = {(r.conv_id, r.pos): r.us for r in ingest.fill_times(rows, 1000 * m).collect()}
    assert got == {("a", 0): 99 * m, ("a", 1): 100 * m, ("a", 2): 101 * m, ("a", 3): 101 * m + 1_000_000, ("b", 0): 999 * m, ("b", 1): 1000 * m}


def test_scope_presence(spark):
    t = spark.createDataFrame([(1, 1), (2, 2)], "turn_id long, conversation_id long")
    none = spark.createDataFrame([], "conversation_id long")
    assert lifecycle.scoped(t, none).count() == 0 and lifecycle.scoped(t, None).count() == 2


def test_session_gap_is_inclusive(spark):
    m = 60_000_000
    t = spark.createDataFrame([(1, 1, 0), (2, 1, 30 * m), (3, 1, 60 * m + 1)], "turn_id long, conversation_id long, us long")
    assert [r.session for r in lifecycle.sessions(t, 30).orderBy("turn_id").collect()] == [1, 1, 2]


def test_import_policies(spark):
    day = 86_400_000_000
    df = spark.range(1).select(*[scalars.import_decay(p, F.lit(0), 40 * day, F.lit(False)).alias(p) for p in ("fresh", "preserve", "hybrid", "fast_forward")])
    r = df.first()
    assert r.fresh.score == 1 and r.preserve.immune_until == 54 * day and abs(r.hybrid.score - 0.95**10) < 1e-9 and abs(r.fast_forward.score - 0.95**40) < 1e-9
    with pytest.raises(ValueError):
        scalars.import_decay("other", F.lit(0), 0, F.lit(False))


def test_text_helpers(spark):
    df = spark.createDataFrame([("We use ```never change``` going with A",), ("the bug was fixed",), ("Never change this",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.decision_cue(F.col("t"))).collect()] == ["decision", "incident", "constraint", None, None]
    assert df.select(tx.first_json(F.lit('```json\n{"a": 1}\n```')).cast("string")).first()[0] == '{"a":1}'
    assert df.select(tx.truncate_words(F.lit("One two. Three four. Five six"), 5)).first()[0] == "One two. Three four."


def test_bootstrap_covers_the_mean(spark):
    rows = spark.createDataFrame([("a", float(x % 5)) for x in range(500)], "condition string, score double")
    r = evaluate.bootstrap(rows, 500).first()
    assert r.low < r["mean"] < r.high and r["mean"] == 2.0


def test_export_readers(spark, tmp_path):
    node = lambda parent, role, text, t: {"parent": parent, "message": role and {"author": {"role": role}, "create_time": t, "content": {"parts": [text]}}}
    tree = [{"title": "T", "current_node": "c", "mapping": {"r": node(None, None, "", 0), "a": node("r", "user", "hi", 1.5), "b": node("a", "assistant", "gone", 2), "c": node("a", "assistant", "yo", 3)}}]
    flat = [{"uuid": "u", "name": "F", "chat_messages": [
        {"uuid": "1", "parent_message_uuid": "0", "sender": "human", "created_at": "2026-01-01T00:00:00Z", "text": "", "content": [{"type": "text", "text": "q"}, {"type": "thinking", "text": "no"}]},
        {"uuid": "2", "parent_message_uuid": "1", "sender": "assistant", "created_at": "2026-01-01T00:01:00Z", "text": "old"},
        {"uuid": "3", "parent_message_uuid": "1", "sender": "assistant", "created_at": "2026-01-01T00:02:00Z", "text": "new"}]}]
    frag = lambda kind, text: [{"type": kind, "content": text}]
    replies = [{"id": "d", "title": "D", "inserted_at": "x", "mapping": {
        "root": {"parent": None, "children": ["1"], "message": None}, "1": {"parent": "root", "children": ["2", "3"], "message": {"inserted_at": "2026-01-01T01", "fragments": frag("REQUEST", "ask")}},
        "2": {"parent": "1", "children": [], "message": {"inserted_at": "2026-01-01T03", "fragments": frag("RESPONSE", "late") + frag("THINK", "hm")}},
        "3": {"parent": "1", "children": [], "message": {"inserted_at": "2026-01-01T02", "fragments": frag("RESPONSE", "early")}}}}]
    for n, x in enumerate((tree, flat, replies)):
        (tmp_path / f"{n}.json").write_text(json.dumps(x))
    got = sorted((r.provider, r.pos, r.role, r.text, r.skipped) for r in exports.read_exports(spark, str(tmp_path)).collect())
    assert got == [
        ("chatgpt", 0, "user", "hi", 1), ("chatgpt", 1, "assistant", "yo", 1), ("claude", 0, "user", "q", 1), ("claude", 1, "assistant", "new", 1),
        ("deepseek", 0, "user", "ask", 1), ("deepseek", 1, "assistant", "late", 1),
    ]
    with pytest.raises(ValueError):
        exports.sniff("plain text")


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"role":"user","content":"q","timestamp":"2026-01-01T00:00:00Z","conversation":"c"}\n{"prompt":"p","response":"r","conversation_id":"d","timestamp":"12.5"}\nbroken\n')
    got = exports.read_jsonl(spark, str(tmp_path / "a.jsonl"), salvage=True).collect()
    assert sorted((r.source_id, r.pos, r.role, r.text, r.us) for r in got) == [("c", 0, "user", "q", 1767225600000000), ("d", 0, "user", "p", 12500000), ("d", 1, "assistant", "r", 12500000)]
    with pytest.raises(Exception):
        exports.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "id long, t string, embedding array<double>")
    store.export_store({"x": df}, str(tmp_path / "s"))
    back = store.import_store(spark, str(tmp_path / "s"), {"x": df.schema}, {"x": (df.where("id = 1").withColumn("t", F.lit("kept")), "id")})["x"]
    assert sorted((r.id, r.t) for r in back.collect()) == [(1, "kept"), (2, "b")]
    with pytest.raises(ValueError):
        store.check_vectors(df, "embedding", 2)
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    assert store.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b"]


def _package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://x/w"'
    (tmp_path / "a.docx").write_bytes(_package({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two &amp; three</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>"}))
    slide = lambda t: f'<p:sld xmlns:p="http://x/p" xmlns:a="http://x/a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    (tmp_path / "b.pptx").write_bytes(_package({f"ppt/slides/slide{n}.xml": slide(f"slide {n}") for n in (1, 10, 2)}))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    got = {(r.path.rsplit("/", 1)[-1], r.part): (r.text, r.error is not None) for r in office.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", 0): ("One\ttwo & three\nEnd", False), ("b.pptx", 0): ("slide 1", False), ("b.pptx", 1): ("slide 2", False), ("b.pptx", 2): ("slide 10", False), ("c.docx", 0): (None, True)}
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    (tmp_path / "d.xlsx").write_bytes(_package({"xl/workbook.xml": '<workbook><sheets><sheet name="First"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>no</t></si><si><r><t>ye</t></r><r><t>s</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet}))
    rows = [(r.sheet, r.row, r.cells) for r in office.read_sheets(spark, str(tmp_path)).collect()]
    assert sorted(rows) == [("First", 1, ["yes", None, "2.5"]), ("First", 3, [None, "in"])]


def test_backups_keep_the_newest(spark, tmp_path):
    tables = {"t": spark.range(3)}
    for n in range(4):
        kept = store.backup(tables, str(tmp_path / "b"), f"2024-01-0{n + 1}", keep=2)
    assert kept == ["2024-01-03", "2024-01-04"]
    assert store.import_store(spark, str(tmp_path / "b" / kept[-1]), {"t": "id long"})["t"].count() == 3


def test_bad_lines_are_named_and_counted(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"role": "user", "content": "a"}\nnot json\n{"role": "assistant", "content": "b"}\n{"role":\n')
    with pytest.raises(ValueError, match="line 2 of x.jsonl"):
        exports.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert {r.skipped for r in exports.read_jsonl(spark, str(tmp_path / "x.jsonl"), salvage=True).collect()} == {2}


def test_seams_of_models(spark):
    from engram.operators import seams as sm

    prompts = spark.createDataFrame([(1, "who inspired it"), (2, ""), (3, None)], "prompt_id long, text string")
    near = spark.createDataFrame([(1, "inspired_by", 0.9), (1, "uses", 0.5), (1, "knows", 0.44), (2, "knows", 0.45)], "prompt_id long, relation string, score double")
    found = sorted(map(tuple, sm.detected_relations(prompts, near).collect()))
    assert found == [(1, "inspired_by", "words"), (1, "uses", "gloss"), (2, "knows", "gloss")]

    replies = spark.createDataFrame([(1, '[{"subject": "A", "relation": "uses"}]', None), (2, "[1, 2]", ["a"]), (3, None, None)], "id long, reply string, entities array<string>")
    facts, gaps = sm.triples(replies)
    assert facts.count() == gaps.count() == 0

    edges = spark.createDataFrame([(7, 1, "friend", 2), (8, 1, "uses", 3), (9, 1, "uses", 4)], "edge_id long, source long, relation string, target long")
    new = spark.createDataFrame([(1, 1, "enemy", 2, False), (2, 1, "uses", 3, True), (3, 1, "uses", 5, True), (4, 1, "uses", 5, False), (5, 1, "enemy", 3, True)], "id long, source long, relation string, target long, cue boolean")
    assert sorted(map(tuple, sm.conflicts(new, edges).collect())) == [(1, "antonym", 7), (2, "supersession", 9), (3, "supersession", 8)]
    assert sm.conflicts(new.limit(0), edges).count() == 0 and sm.conflicts(new, edges.limit(0)).count() == 0
