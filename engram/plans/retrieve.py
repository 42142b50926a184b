"""Search, fusion and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.config import DEFAULTS
from engram.functions import scalars, vectors
from engram.functions import text as tx
from engram.lineage import cut
from engram.operators import lexical
from engram.operators import retrieve as rt
from engram.operators.assemble import fuse
from engram.plans.base import Plans
from engram.sources.driver import DAY_US, NOW_US, TURNS_SQL, read, turns

PLANS = Plans()
add = PLANS.add
WS = r"[ \t\n\r\f\x0B]+"
#: Every vector whose id is divisible by this asks.
EVERY = 100

V_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe, label AS qlabel FROM v WHERE vec_id % 100 = 0)"
SIM = "round(list_dot_product(qe, e), 6)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank"


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("qlabel"))


@add(f"WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(qe, e), 6) AS score FROM q, v), r AS (SELECT *, {RANK} FROM s) SELECT * FROM r WHERE rank <= 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vectors.block_topk(v, q, 20, "vec_id", "embedding", cosine=True)


DECAYED = "least(1.0, (vec_id % 10 + 1) / 10.0::DOUBLE) * (1 + 0.25 * exp(-(vec_id % 90) / 30.0::DOUBLE))"


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, round(list_dot_product(qe, e) * {DECAYED}, 6) AS score FROM q, v WHERE vec_id % 11 > 0),
r AS (SELECT *, {RANK} FROM s) SELECT * FROM r WHERE rank <= 20""")
def vector_topk_decay_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of a vector: vec_id % 90 days; decay: tenths."""
    v, q = _vectors(spark, sf_dir)
    decay = F.least(F.lit(1.0), (F.col("vec_id") % 10 + 1) / 10)
    us = F.lit(NOW_US) - F.col("vec_id") % 90 * DAY_US
    weighted = v.where("vec_id % 11 > 0").withColumn("w", decay * scalars.recency(us, F.lit(NOW_US), 0.25, 30.0))
    return vectors.block_topk(weighted, q, 20, "vec_id", "embedding", "w")


STOP_SQL = ", ".join(f"'{w}'" for w in tx.SEARCH_STOP_WORDS)
TERMS_SQL = f"""q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(list_filter(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: length(w) > 2)[1:30], lambda w: w NOT IN ({STOP_SQL}))) AS term FROM benchmark)),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents)"""


def _asked(spark, sf_dir):
    """Every item asks with its first terms."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.search_terms(F.col("text"))).alias("term")).distinct()


@add(f"""WITH {TERMS_SQL}, t AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d), h AS (SELECT query_id, doc_id, count(*) AS hits FROM q JOIN t USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id)::INT AS rank FROM h) SELECT * FROM r WHERE rank <= 100""")
def lexical_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.lexical_overlap(read(spark, sf_dir, "documents"), _asked(spark, sf_dir), 100)


@add(f"""WITH {TERMS_SQL}, st AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
p AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (term), st),
s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM p JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index_of(read(spark, sf_dir, "documents")), _asked(spark, sf_dir), 20)


@add(f"""WITH q AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(list_filter(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: length(w) > 2)[1:3], lambda w: w NOT IN ({STOP_SQL}))) AS term FROM benchmark)),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM d), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
p AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (term), st), n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM p JOIN q USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def bm25_every_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search falls back to: documents that hold all of an item's first terms."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.search_terms(F.col("text"), 3)).alias("term")).distinct()
    return lexical.search(lexical.index_of(read(spark, sf_dir, "documents")), asked, 20, every=True)


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, vec_id % 37 AS parent, {SIM} AS score FROM q, v),
t AS (SELECT *, {RANK} FROM s), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, id) AS nth FROM t WHERE rank <= 30)
SELECT query_id, id, parent, score FROM c WHERE nth <= 3""")
def chunk_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of parents: at most 30 candidates, three a parent."""
    v, q = _vectors(spark, sf_dir)
    found = vectors.block_topk(v, q, 30, "vec_id", "embedding").withColumn("parent", F.col("id") % 37)
    return rt.cap_per(found, ["query_id", "parent"], [F.desc("score"), F.asc("id")], 3).select("query_id", "id", "parent", "score")


@add(f"""WITH {V_SQL}, c AS (SELECT label AS cluster_id, list(e ORDER BY vec_id) AS es FROM v GROUP BY 1),
d AS (SELECT label AS cluster_id, i, avg(e[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL),
m AS (SELECT cluster_id, list(x ORDER BY i) AS cen FROM d GROUP BY 1), n AS (SELECT cluster_id, list_transform(cen, lambda x: x / sqrt(list_dot_product(cen, cen))) AS cen FROM m),
s AS (SELECT query_id, cluster_id, round(list_dot_product(qe, cen) + CASE WHEN qlabel = cluster_id THEN 0.3 ELSE 0 END, 6) AS score FROM q, n),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cluster_id) AS nth FROM b WHERE best >= 0.5 AND score >= 0.8 * best)
SELECT query_id, cluster_id, score FROM k WHERE nth <= 10""")
def cluster_preselect_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.operators.lifecycle import centroids

    v, q = _vectors(spark, sf_dir)
    centres = centroids(v, "label", "embedding").withColumnRenamed("label", "cluster_id")
    # what the bonus can lift into the first places is the cluster of the query's own label, so it is scored besides the nearest
    near = vectors.block_topk(centres, q.select("query_id", "vector"), DEFAULTS.cluster_top, "cluster_id", "centroid", digits=12).select("query_id", F.col("id").alias("cluster_id"), "score")
    own = q.join(centres, F.col("qlabel") == F.col("cluster_id")).select("query_id", F.col("cluster_id").cast("long"), F.round(vectors.dot(F.col("vector"), F.col("centroid")), 12).alias("score"), F.lit(True).alias("own"))
    both = near.join(own.select("query_id", "cluster_id", "own"), ["query_id", "cluster_id"], "left_anti").withColumn("own", F.lit(False)).unionByName(own)
    scored = both.select("query_id", F.col("cluster_id").cast("int"), F.round(F.col("score") + F.when(F.col("own"), 0.3).otherwise(0.0), 6).alias("score"))
    return rt.preselect_clusters(scored)


RRF_SQL = f"""WITH {V_SQL}, qt AS (SELECT query_id, text FROM q JOIN documents ON doc_id = query_id),
ask AS (SELECT DISTINCT query_id, unnest(list_filter(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: length(w) > 2)[1:30], lambda w: w NOT IN ({STOP_SQL}))) AS term FROM qt),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents), dn AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM dw),
dt AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM dw), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM ask) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bp AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (term), dn),
bs AS (SELECT query_id, doc_id AS id, round(sum(part), 6) AS score FROM bp JOIN ask USING (term) GROUP BY ALL), bk AS (SELECT *, {RANK} FROM bs), br AS (SELECT bk.*, md5(text) AS key FROM bk JOIN documents ON doc_id = id WHERE rank <= 100),
vs AS (SELECT query_id, vec_id AS id, {SIM} AS score FROM q, v), vk AS (SELECT *, {RANK} FROM vs), vr AS (SELECT vk.*, coalesce(md5(text), id::VARCHAR) AS key FROM vk LEFT JOIN documents ON doc_id = id WHERE rank <= 100),
u AS (SELECT query_id, id, rank, key, 0.8 AS w, 'bm25' AS leg, 0 AS nth FROM br UNION ALL SELECT query_id, id, rank, key, 1.0, 'vector', 1 FROM vr),
f AS (SELECT query_id, arg_min(id, (nth, rank, id)) AS id, round(sum(w::DOUBLE / (60 + rank)), 9) AS score, arg_min(leg, (nth, rank, id)) AS leg FROM u GROUP BY query_id, key), r AS (SELECT *, {RANK} FROM f)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, source, vector): the documents of the asking vectors are the prompts."""
    v, q = _vectors(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text", "source")
    return docs.join(q.select("query_id", "vector"), "query_id")


def legs_by_text(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The lexical and the vector leg of every prompt: (query_id, id, score, rank, key), the key a hash of the text."""
    v, q = _vectors(spark, sf_dir)
    docs = read(spark, sf_dir, "documents")
    asked = prompts(spark, sf_dir).select("query_id", F.explode(tx.search_terms(F.col("text"))).alias("term"))
    worded = lexical.search(lexical.index_of(docs), asked, 100).withColumnRenamed("doc_id", "id")
    near = vectors.block_topk(v, q, 100, "vec_id", "embedding")
    key = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text")).alias("key"))
    keyed = lambda leg: leg.join(key, "id", "left").select("query_id", "id", "score", "rank", F.coalesce("key", F.col("id").cast("string")).alias("key"))
    # a leg is small, and is read by the fusion and by what comes after it
    return {"bm25": cut(keyed(worded)), "vector": cut(keyed(near))}


@add(RRF_SQL + " SELECT * FROM r WHERE rank <= 10")
def rrf_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(legs_by_text(spark, sf_dir), rt.BASE_WEIGHTS, 10)


@add(RRF_SQL + """, c AS (SELECT *, id % 13 AS conv, row_number() OVER (PARTITION BY query_id, id % 13 ORDER BY score DESC, id) AS nth FROM r WHERE rank <= 60)
SELECT query_id, id, conv, score FROM c WHERE nth <= 3 OR conv = query_id % 13""")
def session_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fuse(legs_by_text(spark, sf_dir), rt.BASE_WEIGHTS, 60).withColumn("conv", F.col("id") % 13)
    own = F.col("conv") == F.col("query_id") % 13
    return rt.cap_per(fused, ["query_id", "conv"], [F.desc("score"), F.asc("id")], 3, own).select("query_id", "id", "conv", "score")


@add(RRF_SQL + """, c AS (SELECT *, CASE WHEN id % 5 > 0 THEN id % 29 END AS source FROM r WHERE rank <= 60),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS nth FROM c)
SELECT query_id, id, source, score FROM n WHERE nth <= 2 OR source IS NULL""")
def provenance_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fuse(legs_by_text(spark, sf_dir), rt.BASE_WEIGHTS, 60).withColumn("source", F.when(F.col("id") % 5 > 0, F.col("id") % 29))
    return rt.cap_per(fused, ["query_id", "source"], [F.desc("score"), F.asc("id")], 2, F.col("source").isNull()).select("query_id", "id", "source", "score")


def _weights_sql() -> str:
    rows = [f"('{n}', '{leg}', {w})" for n, p in rt.PROFILES.items() for leg, w in p.items()]
    known = "', '".join(rt.PROFILES)
    base = ", ".join(f"('{leg}', {w})" for leg, w in rt.BASE_WEIGHTS.items())
    deltas = ", ".join(f"('{t}', '{leg}', {w})" for t, p in rt.TOPIC_DELTAS.items() for leg, w in p.items())
    names = "', '".join([*rt.PROFILES, "Unlisted"])
    return f"""WITH p(intent, leg, w) AS (VALUES {", ".join(rows)}), b(leg, w) AS (VALUES {base}), d(topic, leg, w) AS (VALUES {deltas}),
names AS (SELECT ['{names}'] AS all_), q AS (SELECT doc_id AS query_id, all_[doc_id % 14 + 1] AS i1, CASE WHEN doc_id % 3 = 0 THEN all_[(doc_id * 5) % 14 + 1] END AS i2,
 CASE WHEN doc_id % 7 = 0 THEN 'Creative_&_Media' WHEN doc_id % 7 = 1 THEN 'Software_&_Tech' END AS topic, doc_id % 11 = 0 AS none FROM documents, names),
i AS (SELECT query_id, i1 AS intent FROM q WHERE NOT none UNION ALL SELECT query_id, i2 FROM q WHERE i2 IS NOT NULL AND NOT none),
m AS (SELECT i.query_id, b.leg, avg(CASE WHEN i.intent IN ('{known}') THEN coalesce(p.w, 0) ELSE b.w END::DOUBLE) AS w FROM i CROSS JOIN b LEFT JOIN p ON p.intent = i.intent AND p.leg = b.leg GROUP BY ALL)
SELECT q.query_id, b.leg, CASE WHEN b.leg = 'timeline' THEN 0.6 ELSE round(greatest(0, coalesce(m.w, b.w) + coalesce(d.w, 0)), 6) END::DOUBLE AS weight
FROM q CROSS JOIN b LEFT JOIN m ON m.query_id = q.query_id AND m.leg = b.leg LEFT JOIN d ON d.topic = q.topic AND d.leg = b.leg"""


@add(_weights_sql())
def leg_weight_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [*rt.PROFILES, "Unlisted"]))
    d = F.col("doc_id")
    one, two = F.element_at(names, (d % 14 + 1).cast("int")), F.element_at(names, (d * 5 % 14 + 1).cast("int"))
    intents = F.when(d % 11 == 0, F.array().cast("array<string>")).when(d % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    topics = F.when(d % 7 == 0, F.array(F.lit("Creative_&_Media"))).when(d % 7 == 1, F.array(F.lit("Software_&_Tech"))).otherwise(F.array().cast("array<string>"))
    return rt.leg_weights(read(spark, sf_dir, "documents").select(d.alias("query_id"), intents.alias("intents"), topics.alias("topics")))


SHARE_SQL = f"""{TURNS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS total, rank() OVER (PARTITION BY conversation_id ORDER BY us DESC) - 1 AS newer FROM turns)"""


@add(f"WITH {SHARE_SQL} SELECT turn_id, newer, total, round(newer / total, 6) AS share FROM n")
def recency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.newer_share(turns(spark, sf_dir)).select("turn_id", F.col("newer").cast("long").alias("newer"), "total", F.round("share", 6).alias("share"))


@add(f"""WITH d AS (SELECT doc_id, lower(text) AS low, len(list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '')) AS n, (doc_id % 100) / 100.0::DOUBLE AS share FROM documents),
b AS (SELECT doc_id, CASE WHEN contains(low, 'thtions') OR contains(low, 'thtion') OR contains(low, 'ungheit') THEN 1.0 ELSE 0 END
 + CASE WHEN n > 800 THEN 1.5 WHEN n > 400 THEN 0.5 WHEN n < 80 THEN -0.7 ELSE 0 END
 + CASE WHEN doc_id % 40 <= 20 THEN 0 WHEN share < 0.1 THEN 1.0 WHEN share < 0.3 THEN 0.5 ELSE 0 END - CASE WHEN doc_id % 6 = 0 THEN 0.45 ELSE 0 END AS raw FROM d)
SELECT doc_id, round(least(4.0, greatest(-0.9, raw)), 6)::DOUBLE AS bonus FROM b""")
def bonus_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    made = rt.bonus(F.col("text"), F.array(F.lit("thtions"), F.lit("ungheit")), (d % 100) / 100, d % 6 == 0, d % 40)
    return read(spark, sf_dir, "documents").select("doc_id", F.round(made, 6).alias("bonus"))


@add(f"""WITH {TURNS_SQL}, s AS (SELECT turn_id, conversation_id, us, round(value, 6) AS score FROM turns),
e AS (SELECT *, floor((row_number() OVER (PARTITION BY conversation_id ORDER BY us, turn_id) - 1) / ceil(count(*) OVER (PARTITION BY conversation_id) / 4.0))::INT AS era FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, era ORDER BY score DESC, turn_id) AS nth FROM e)
SELECT turn_id, conversation_id, era, score FROM r WHERE nth <= 3""")
def era_stratify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("turn_id", "conversation_id", "us", F.round("value", 6).alias("score"))
    return rt.era_strata(rows, ["conversation_id"]).select("turn_id", "conversation_id", "era", "score")


COLD = (NOW_US - 20 * DAY_US, NOW_US - 10 * DAY_US)


@add(f"""WITH {TURNS_SQL}, c AS (SELECT conversation_id, turn_id, 0.6 AS score, row_number() OVER (PARTITION BY conversation_id
 ORDER BY coalesce(CASE WHEN k % 3 > 0 THEN k / 100.0::DOUBLE END, 1), us DESC, turn_id)::INT AS rank FROM turns WHERE is_archived AND us >= {COLD[0]} AND us < {COLD[1]})
SELECT conversation_id, turn_id, score::DOUBLE AS score, rank FROM c WHERE rank <= 5""")
def cold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived turns of a window, by distance (null counts as 1), five a conversation, at a fixed score."""
    rows = turns(spark, sf_dir).where(F.col("is_archived") & (F.col("us") >= COLD[0]) & (F.col("us") < COLD[1]))
    from pyspark.sql import Window

    near = F.coalesce(F.when(F.col("k") % 3 > 0, F.col("k") / 100), F.lit(1.0))
    order = Window.partitionBy("conversation_id").orderBy(near, F.desc("us"), "turn_id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("conversation_id", "turn_id", F.lit(0.6).alias("score"), "rank")


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, label = qlabel AS own, {SIM} AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, id) AS nth FROM s)
SELECT query_id, id, CASE WHEN own THEN 'own' ELSE 'others' END AS half, score FROM r WHERE (own AND nth <= 3) OR (NOT own AND nth <= 2)""")
def batch_summary_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as batch summaries, labels as conversations: three of one's own, two of others."""
    v, q = _vectors(spark, sf_dir)
    asked, rows = q.withColumnRenamed("qlabel", "conv"), v.withColumnRenamed("label", "conv")
    own = vectors.block_topk(rows, asked, 3, "vec_id", "embedding", group="conv").withColumn("half", F.lit("own"))
    others = vectors.block_topk(rows, asked, 2, "vec_id", "embedding", group="conv", same=False).withColumn("half", F.lit("others"))
    out = own.unionByName(others)
    return out.select("query_id", "id", "half", "score")


@add(f"""WITH {TURNS_SQL}, t AS (SELECT turn_id, (k + 0.5) / 100.0::DOUBLE AS p, (turn_id % 600) AS n, value * 100 AS tokens, topic FROM turns),
l AS (SELECT *, 1 / (1 + exp(-greatest(0.0, greatest(0.0, tokens - CASE WHEN n < 10 THEN 0.3 WHEN n < 200 THEN 0.2 ELSE 0.15 END * 21200.0::DOUBLE) - 2000) / 4000)) AS p_len FROM t),
o AS (SELECT *, ln(p / (1 - p)) + 0.4 + 0.8 * ln(p_len / (1 - p_len)) + CASE WHEN topic = 'view' THEN 0.7 ELSE 0 END + CASE WHEN turn_id % 2 = 0 THEN 0.5 ELSE 0 END
 + CASE WHEN topic = 'error' THEN 0.8 ELSE 0 END + CASE WHEN turn_id % 19 = 0 THEN 3.0 ELSE 0 END + CASE WHEN turn_id % 13 = 0 THEN 0.7 ELSE 0 END AS odds FROM l)
SELECT turn_id, round(p_len, 6) AS p_len, round(1 / (1 + exp(-odds)), 6) AS p_need, 1 / (1 + exp(-odds)) > 0.5 AS retrieve FROM o""")
def memory_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn_id")
    made = scalars.memory_decision((F.col("k") + 0.5) / 100, t % 600, F.col("value") * 100, F.col("topic") == "view", t % 2 == 0, F.col("topic") == "error", t % 19 == 0, t % 13 == 0)
    return turns(spark, sf_dir).select("turn_id", made.alias("m")).select("turn_id", F.round("m.p_len", 6).alias("p_len"), F.round("m.p_need", 6).alias("p_need"), "m.retrieve")


@add("""WITH t AS (SELECT event_id, event_id % 700 AS n, floor(value * 900)::BIGINT AS tokens, 23000 - 1800 AS available FROM events),
f AS (SELECT *, least(0.85, greatest(0.05, CASE WHEN n < 10 THEN 0.3 WHEN n < 200 THEN 0.2 ELSE 0.15 END
 + CASE WHEN n > 0 AND tokens > 0 THEN CASE WHEN tokens / greatest(n, 1) > 3000 THEN -0.15 WHEN tokens / greatest(n, 1) > 1500 THEN -0.10 WHEN tokens / greatest(n, 1) > 800 THEN -0.05 ELSE 0 END ELSE 0 END))::DOUBLE AS share FROM t),
r AS (SELECT *, floor(available * share)::BIGINT AS recent FROM f)
SELECT event_id, recent, least(available - recent, CASE WHEN n < 30 THEN 2000 + n * 150 WHEN n < 100 THEN 5000 + (n - 30) * 100 WHEN n < 500 THEN 10000 + (n - 100) * 30 ELSE available - recent END)::BIGINT AS retrieval FROM r""")
def budget_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scalars.retrieval_budget(F.col("event_id") % 700, F.floor(F.col("value") * 900), F.lit(23_000))
    return read(spark, sf_dir, "events").select("event_id", made.alias("b")).select("event_id", "b.recent", "b.retrieval")


@add("""WITH t AS (SELECT event_id, (event_id % 100) * 1000 AS w FROM events)
SELECT event_id, CASE WHEN w = 0 THEN 23000 ELSE least(greatest(4000, least(40000, floor(w * 0.75))), CASE WHEN w - 2048 <= 0 THEN greatest(1, floor(w / 2.0)) ELSE w - 2048 END) END::BIGINT AS budget FROM t""")
def model_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalars.model_budget(F.col("event_id") % 100 * 1000).alias("budget"))


@add("""WITH q AS (SELECT c_custkey AS query_id, [c_mktsegment, 'N' || c_nationkey] AS tags, c_custkey % 5 AS need FROM customer),
m AS (SELECT 'model' || n_nationkey AS model, ['N' || n_nationkey, ['HOUSEHOLD','MACHINERY','BUILDING','AUTOMOBILE','FURNITURE'][n_nationkey % 5 + 1]] AS model_tags, n_nationkey % 2 AS priority, n_nationkey % 7 AS window_, n_nationkey AS nth FROM nation),
s AS (SELECT query_id, model, nth, len(list_intersect(tags, model_tags)) + priority AS score FROM q JOIN m ON window_ >= need)
SELECT query_id, arg_max(model, (score, -nth)) AS model, max(score)::INT AS score FROM s GROUP BY 1""")
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.array("c_mktsegment", F.concat(F.lit("N"), "c_nationkey")).alias("tags"), (F.col("c_custkey") % 5).alias("need"))
    segments = F.array(*map(F.lit, ("HOUSEHOLD", "MACHINERY", "BUILDING", "AUTOMOBILE", "FURNITURE")))
    n = F.col("n_nationkey")
    m = read(spark, sf_dir, "nation").select(
        F.concat(F.lit("model"), n).alias("model"), F.array(F.concat(F.lit("N"), n), F.element_at(segments, n % 5 + 1)).alias("model_tags"),
        (n % 2).alias("priority"), (n % 7).alias("window"), n.alias("nth"),
    )
    return rt.route_models(q, m).select("query_id", "model", F.col("score").cast("int").alias("score"))


@add("""WITH s AS (SELECT p_brand || '.' || p_name || ':' || p_type AS symbol, p_partkey FROM part), q(query_id, name) AS (VALUES (1, 'ECONOMY'), (2, 'ring:ECONOMY')),
r AS (SELECT query_id, symbol, p_partkey, row_number() OVER (PARTITION BY query_id ORDER BY length(symbol), symbol, p_partkey)::INT AS rank FROM s JOIN q
ON symbol = name OR ends_with(symbol, '.' || name) OR ends_with(symbol, ':' || name)) SELECT query_id, symbol, rank FROM r WHERE rank <= 10""")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("."), "p_name", F.lit(":"), "p_type").alias("symbol"))
    out = None
    for n, name in ((1, "ECONOMY"), (2, "ring:ECONOMY")):
        found = rt.symbol_lookup(symbols.withColumn("query_id", F.lit(n)), F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "symbol", "rank")
