"""Queries of the sequential operators and sources; most are held against Python twins in the tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.chunking import chunk_documents
from engram.functions.timescope import timescope
from engram.operators import retrieve as rt
from engram.operators import select
from engram.operators.assemble import fuse
from engram.plans.base import Plans
from engram.plans.retrieve import _vectors, legs_by_text
from engram.sources import store
from engram.sources.driver import read

PLANS = Plans()
add = PLANS.add
NOW = datetime(2026, 7, 10, 12)


@add()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk_documents(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "chunk", F.sha2("text", 256).alias("sha"), "tokens")


#: What the phrases of ``timescope_detect`` mean on the day of NOW, worked out by hand: (mode, start, end, words that say so).
TIMES_SQL = """VALUES (0, 'as_of', '2025-02-15 00:00:00', '2025-04-15 00:00:00', 'march 2025'), (1, 'as_of', '2026-06-11 02:24:00', '2026-06-27 21:36:00', '3 weeks ago'),
(2, 'as_of', '2026-07-06 00:00:00', '2026-07-10 12:00:00', 'yesterday'), (3, 'range', '2022-12-02 00:00:00', '2026-07-10 12:00:00', 'since 2023'),
(4, 'range', '2023-12-18 00:00:00', '2024-04-15 00:00:00', 'between january 2024 and march 2024'), (5, 'range', '2025-11-10 00:00:00', '2026-03-22 00:00:00', 'last winter'),
(6, 'evolution', NULL, NULL, 'over time'), (7, 'current', NULL, NULL, ''), (8, 'range', '2024-03-11 00:00:00', '2024-07-22 00:00:00', 'Q2 2024'), (9, 'as_of', '2026-05-18 00:00:00', '2026-06-04 00:00:00', 'late may')"""


@add(f"""WITH p(phrase, mode, t0, t1, matched) AS ({TIMES_SQL}), e AS (SELECT event_id, event_id % 4 AS head, user_id % 10 AS phrase FROM events)
SELECT event_id, CASE head WHEN 1 THEN 'current' WHEN 2 THEN 'evolution' ELSE mode END AS mode, CASE WHEN head <> 1 THEN epoch_us(t0::TIMESTAMP) END AS t0, CASE WHEN head <> 1 THEN epoch_us(t1::TIMESTAMP) END AS t1,
CASE head WHEN 1 THEN '' WHEN 2 THEN CASE WHEN phrase = 6 THEN 'how has it changed; over time' WHEN phrase = 7 THEN 'how has it changed' ELSE matched || '; how has it changed' END ELSE matched END AS matched
FROM e JOIN p USING (phrase)""")
def timescope_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = ("in march 2025", "3 weeks ago", "yesterday", "since 2023", "between january 2024 and march 2024", "last winter", "over time", "in the code", "Q2 2024", "late may")
    heads = ("what did we plan", "we planned", "how has it changed", "show me the notes from")
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    prompt = F.concat_ws(" ", pick(heads, F.col("event_id")), pick(phrases, F.col("user_id")))
    rows = read(spark, sf_dir, "events").select("event_id", prompt.alias("prompt"))
    return rows.select("event_id", timescope(F.col("prompt"), NOW).alias("t")).select("event_id", "t.mode", "t.t0", "t.t1", "t.matched")


@add()
def token_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fuse(legs_by_text(spark, sf_dir), rt.BASE_WEIGHTS, 60)
    size = (F.col("id") % 17 + 1) * 40
    rows = fused.select(
        "query_id", "id", "leg", "score", size.alias("tokens"), F.when(F.col("id") % 3 > 0, F.floor(size / 4)).alias("summary_tokens"), F.when(F.col("id") % 2 > 0, F.lit(8)).alias("abstract_tokens")
    )
    return select.token_budget(rows, 3000)


@add()
def coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    fused = fuse(legs_by_text(spark, sf_dir), rt.BASE_WEIGHTS, 60)
    rows = fused.join(v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 19 > 0, F.col("embedding")).alias("vector")), "id").join(q.select("query_id", F.col("vector").alias("query")), "query_id")
    return select.coverage(rows.select("query_id", "id", "score", "vector", "query"))


def _decoded(text: str) -> str:
    """SQL of character references decoded: those that the pages hold, which HTML also reads without their semicolon; the ampersand last, so nothing is decoded twice."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{sign}', 'g')"
    return text


@add(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript)\b.*?(</(script|style|noscript)\s*>|$)', chr(10), 'gis'), '<!--.*?(-->|$)', chr(10), 'gs'), '<[^>]*(>|$)', chr(10), 'gs') AS t,
 regexp_extract(html, '<title\b[^>]*>(.*?)</title>', 1, 'is') AS title, trim(regexp_replace(regexp_extract(html, '<h1\b[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]*>', '', 'gs')) AS h1 FROM pages),
r AS (SELECT page_id, {_decoded("CASE WHEN trim(title) <> '' THEN trim(title) ELSE h1 END")} AS title, {_decoded('t')} AS t FROM b)
SELECT page_id, title, sha256(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS text_sha FROM r""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", store.page_title().alias("title"), F.sha2(store.page_lines(), 256).alias("text_sha"))

