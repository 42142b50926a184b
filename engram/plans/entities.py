"""Entities taken from the documents' texts: duplicates, and mentions matched to them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.lineage import cut
from engram.operators import clusters as cl
from engram.operators import duplicates as dup
from engram.operators import joins
from engram.plans.base import Plans
from engram.sources.driver import NOW_US, micros, read

PLANS = Plans()
add = PLANS.add
WIDTH = 64
WORDS = r"[^\p{L}]+"
#: Texts whose words are told apart at once.
TEXTS = 1000


def hashed_entities(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, group, names, vector) of rows (id, group, text).

    The vector is made by feature hashing: each distinct word adds 1 or -1 at a place, both by its md5; null without words.  Names are the first and
    the last four words of a text of eight or more.  Texts are split, and their words told apart, some at a time by Arrow where they lie, so no word is shuffled.
    """

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(batch["text"], "")), WORDS)
        words, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
        real = pc.not_equal(words, "")
        words, of = words.filter(real), of[real.to_numpy(zero_copy_only=False)]
        held = np.bincount(of, minlength=n)
        ends = np.cumsum(held)
        coded = words.dictionary_encode()
        each = coded.dictionary.cast("large_binary")
        starts, letters = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, 8 * each.offset).tolist(), each.buffers()[2] or b""
        letters = memoryview(letters)
        told = np.frombuffer(b"".join([md5(letters[a:b]).digest()[:3] for a, b in pairwise(starts)]), np.uint8).reshape(-1, 3).astype(np.int64)
        place, sign = (told[:, 0] * 256 + told[:, 1]) % width, np.where(told[:, 2] < 128, 1.0, -1.0)
        met = np.sort(of * len(told) + coded.indices.to_numpy())
        row, word = np.divmod(met[np.diff(met, prepend=-1) > 0], max(1, len(told)))
        vectors = np.bincount(row * width + place[word], sign[word], n * width)
        vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(vectors), mask=pa.array(held == 0))
        long = np.flatnonzero(held >= 8)
        four = lambda at: pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(4)], " ")
        first, last = four((ends - held)[long]), four(ends[long] - 4)
        both = pa.concat_arrays([first, last]).take(pa.array(np.arange(2 * len(long)).reshape(2, -1).T.ravel()))
        names = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * (held >= 8)))).astype(np.int32)), both)
        return pa.RecordBatch.from_arrays([batch["id"], batch["group"], names, vector], names=["id", "group", "names", "vector"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                yield made(batch.slice(at, TEXTS))

    kind = texts.schema["group"].dataType.simpleString()
    return texts.select(F.col("id").cast("long"), "group", "text").mapInArrow(make, f"id long, group {kind}, names array<string>, vector array<double>")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities (id, group, names, vector): the language is the type, first and last words are the names."""
    return cut(hashed_entities(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), "text")))


ENTITIES_SQL = r"""w AS (SELECT doc_id AS id, lang AS grp, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT id, ('0x' || substr(md5(x), 1, 4))::INT % 64 AS pos, sum(CASE WHEN substr(md5(x), 5, 1) < '8' THEN 1.0 ELSE -1.0 END) AS v FROM (SELECT DISTINCT id, unnest(w) AS x FROM w) GROUP BY ALL),
g AS (SELECT id, sqrt(sum(v * v)) AS size FROM f GROUP BY id HAVING sum(v * v) > 0),
c AS (SELECT i.id, i.n AS pos, coalesce(f.v, 0) / g.size AS v FROM (SELECT id, unnest(range(64)) AS n FROM g) i JOIN g ON g.id = i.id LEFT JOIN f ON f.id = i.id AND f.pos = i.n),
e AS (SELECT id, list(v::DOUBLE ORDER BY pos) AS e FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(x.e, y.e), 9) AS cosine FROM w a JOIN w b ON a.grp IS NOT DISTINCT FROM b.grp AND a.id < b.id JOIN e x ON x.id = a.id JOIN e y ON y.id = b.id WHERE round(list_dot_product(x.e, y.e), 9) >= 0.9),
nm AS (SELECT DISTINCT id, name FROM (SELECT id, unnest([array_to_string(w[1:4], ' '), array_to_string(w[-4:], ' ')]) AS name FROM w WHERE len(w) >= 8)),
nl AS (SELECT DISTINCT m.a, nm.id AS b FROM nm JOIN (SELECT name, min(id) AS a FROM nm GROUP BY name) m USING (name) WHERE nm.id <> m.a)"""


@add(f"""WITH RECURSIVE {ENTITIES_SQL}, s AS (SELECT a, b FROM p UNION SELECT a, b FROM nl), z AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
r(a, b) AS (SELECT id, id FROM w UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a), l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT w.id, coalesce(l.links, 0)::BIGINT AS links, min(r.b) AS component FROM w JOIN r ON r.a = w.id LEFT JOIN l ON l.id = w.id GROUP BY ALL""")
def duplicate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of near ones of its source, and the class that vectors and names make."""
    return dup.duplicate_classes(entities(spark, sf_dir))


@add(f"""WITH {ENTITIES_SQL}, v AS (SELECT w.id, min(w.id) OVER (PARTITION BY w.grp, list_transform(e.e, lambda x: round(x, 12))) AS rep FROM w JOIN e ON e.id = w.id),
q AS (SELECT a, b, NULL::DOUBLE AS cosine FROM nl WHERE (a + b) % 97 = 0
  UNION ALL SELECT p.a, p.b, p.cosine FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b WHERE x.rep = p.a AND y.rep IN (p.a, p.b) AND NOT EXISTS (FROM nl WHERE nl.a = p.a AND nl.b = p.b)),
t AS (SELECT *, row_number() OVER (ORDER BY cosine IS NOT NULL, cosine DESC, a, b)::INT AS rank FROM q QUALIFY rank <= 10),
m AS (SELECT user_id AS id, count(*) AS n, min(epoch_us(ts)) AS first FROM events GROUP BY 1),
k AS (SELECT t.*, (-coalesce(x.n, 0), coalesce(x.first, 9223372036854775807), t.a) <= (-coalesce(y.n, 0), coalesce(y.first, 9223372036854775807), t.b) AS keep_a FROM t LEFT JOIN m x ON x.id = t.a LEFT JOIN m y ON y.id = t.b)
SELECT rank, CASE WHEN keep_a THEN a ELSE b END AS keep, CASE WHEN keep_a THEN b ELSE a END AS absorb, cosine FROM k""")
def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten merges; name pairs whose ids don't add up to a multiple of 97 have been decided before."""
    e = entities(spark, sf_dir)
    mentions = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.min(micros("ts")).alias("first"))
    return dup.merge_proposals(e, dup.name_links(e).where("(a + b) % 97 <> 0"), mentions)


@add()
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clusters of one turn each, oldest first: where each one ends.  Rounds to a fixpoint are tested against a plain version."""
    e = entities(spark, sf_dir)
    return cl.merge_clusters(e.select("group", "id", F.col("id").alias("age"), F.lit(1).alias("n"), "vector", F.col("names").alias("cast")))


# the mentions of a prompt one after another: the nearest entity that is free, else the first of the name if it is free
_TAKE = """coalesce((SELECT arg_min(id, (-score, id)) FROM near n WHERE n.prompt = m.prompt AND n.nth = {0} AND NOT list_contains({1}, id)),
  (SELECT id FROM named d WHERE d.name = m.name AND NOT list_contains({1}, id)))"""


@add(f"""WITH v AS (SELECT vec_id AS id, 'e' || vec_id % 7 AS name, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE id % 100 = 0),
m AS (SELECT id AS prompt, 1 AS nth, name, e FROM q UNION ALL SELECT id, 2, 'e' || (id + 1) % 7, e FROM q UNION ALL SELECT id, 3, 'e' || (id + 2) % 7, NULL FROM q),
near AS (SELECT m.prompt, m.nth, v.id, round(list_dot_product(m.e, v.e), 9) AS score FROM m, v WHERE m.e IS NOT NULL AND round(list_dot_product(m.e, v.e), 9) >= 0.85), named AS (SELECT name, min(id) AS id FROM v GROUP BY name),
t1 AS (SELECT prompt, {_TAKE.format(1, "[]::BIGINT[]")} AS x FROM m WHERE nth = 1),
t2 AS (SELECT m.prompt, t1.x AS x, {_TAKE.format(2, "[t1.x]")} AS y FROM m JOIN t1 ON t1.prompt = m.prompt WHERE nth = 2),
t3 AS (SELECT m.prompt, t2.x AS x, t2.y AS y, {_TAKE.format(3, "[t2.x, t2.y]")} AS z FROM m JOIN t2 ON t2.prompt = m.prompt WHERE nth = 3),
u AS (SELECT prompt, 1 AS nth, x AS entity FROM t3 UNION ALL SELECT prompt, 2, y FROM t3 UNION ALL SELECT prompt, 3, z FROM t3)
SELECT u.prompt, u.nth::BIGINT AS nth, u.entity, round(near.score, 6) AS score FROM u LEFT JOIN near ON near.prompt = u.prompt AND near.nth = u.nth AND near.id = u.entity WHERE entity IS NOT NULL""")
def entity_match_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three mentions a prompt: an entity's own vector, the same again, which must find another, and a name without a vector."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.concat(F.lit("E"), (F.col("vec_id") % 7).cast("string"))).alias("names"), F.col("embedding").alias("vector"))
    name = lambda n: F.concat(F.lit("e"), ((F.col("id") + n) % 7).cast("string")).alias("name")
    asked = v.where("id % 100 = 0")
    said = [asked.select(F.col("id").alias("prompt"), F.lit(n + 1).alias("nth"), name(n), F.when(F.lit(n < 2), F.col("vector")).alias("vector")) for n in range(3)]
    found = cl.match_mentions(said[0].unionByName(said[1]).unionByName(said[2]), v)
    return found.select("prompt", "nth", "entity", F.round("score", 6).alias("score"))


# slices of six turns that overlap in two; the last turn of a slice is cut off in the middle
SLICE, STEP = 6, 4


@add(f"""WITH t AS (SELECT conv_id AS title, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT title, pos::INT AS pos, role, text, {NOW_US} - (n - pos) * 60000000 AS us FROM t""")
def seam_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations cut into overlapping slices and joined again at the seams: the conversations as they were."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("title"), "role", F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    of = F.explode(F.filter(F.array(F.floor(F.col("at") / STEP), F.floor(F.col("at") / STEP) - 1), lambda s: (s >= 0) & (F.col("at") - s * STEP < SLICE) & ((s == 0) | (s * STEP + SLICE - STEP < F.col("n"))))).alias("slice")
    rows = t.select("*", of).withColumn("nth", F.col("at") - F.col("slice") * STEP)
    cut_off = (F.col("nth") == SLICE - 1) & (F.col("at") < F.col("n") - 1) & (F.length("text") > 20)
    return joins.joined_at_seams(rows.select("title", "slice", "nth", "role", F.when(cut_off, F.substr("text", F.lit(1), F.length("text") - 5)).otherwise(F.col("text")).alias("text"), F.lit(NOW_US).alias("mtime_us")))


@add(r"""WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), s AS (
  SELECT id, text, greatest(0, x.s) AS s, least(x.e, length(text)) AS e, x.l AS label, x.p AS score FROM (SELECT id, text, unnest([{'s': id % 40, 'e': id % 40 + 9, 'l': 'A', 'p': (id % 10) / 10}, {'s': id % 40 + 6, 'e': id % 40 + 20, 'l': 'B', 'p': 0.45}, {'s': id % 90 + 30, 'e': id % 90 + 33, 'l': 'C', 'p': 0.7}]) AS x FROM d)),
f AS (SELECT *, s - CASE WHEN regexp_matches(substr(text, s + 1, 1), '[\p{L}\p{N}]') THEN length(regexp_extract(substr(text, 1, s), '([\p{L}\p{N}]*)$', 1)) ELSE 0 END AS f, e + CASE WHEN regexp_matches(substr(text, e, 1), '[\p{L}\p{N}]') THEN length(regexp_extract(substr(text, e + 1), '^([\p{L}\p{N}]*)', 1)) ELSE 0 END AS t FROM s WHERE s < e),
p AS (SELECT id, f + length(regexp_extract(substr(text, f + 1, t - f), '^([^\p{L}\p{N}]*)', 1)) AS s, t - length(regexp_extract(substr(text, f + 1, t - f), '([^\p{L}\p{N}]*)$', 1)) AS e, label, score FROM f),
o AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS opens FROM p WHERE s < e),
c AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY s, e, label ROWS UNBOUNDED PRECEDING) AS chain FROM o)
SELECT c.id, min(s)::INT AS start, max(e)::INT AS stop, arg_max(label, (score, e - s, label)) AS label, max(score)::DOUBLE AS score FROM c GROUP BY c.id, chain""")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three taggers over every text, as one."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    i = F.col("id")
    span = lambda start, width, label, score: F.struct((start).cast("int").alias("start"), (start + width).cast("int").alias("stop"), F.lit(label).alias("label"), score.cast("double").alias("score"))
    told = F.array(span(i % 40, 9, "A", i % 10 / 10), span(i % 40 + 6, 14, "B", F.lit(0.45)), span(i % 90 + 30, 3, "C", F.lit(0.7)))
    return joins.united_spans(docs, docs.select("id", F.inline(told))).drop("text")
