"""Queries of the search legs under each query's own scope: turns, chunks, cold store, wide net, graph walk and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import scalars, vectors
from engram.functions import text as tx
from engram.lineage import cut
from engram.operators import assemble as asm
from engram.operators import legs, lexical, recall
from engram.operators import retrieve as rt
from engram.plans.base import Plans
from engram.plans.retrieve import STOP_SQL
from engram.sources.driver import DAY_US, EDGES_SQL, NOW_US, ORDERS_NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
MODES = ("current", "as_of", "range", "evolution")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their vectors: events and embeddings of one id."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("turn_id"), F.col("embedding").alias("vector"))
    links = F.when(F.col("cluster_id").isNull(), F.array().cast("array<int>")).otherwise(F.array("cluster_id"))
    return turns(spark, sf_dir).join(v, "turn_id").select(
        F.col("turn_id").alias("id"), "vector", "us", F.col("conversation_id").alias("conversation"), links.alias("clusters"), "decay", "is_archived", "is_private", "is_document", "k", "topic"
    )


def asked(memory: DataFrame) -> DataFrame:
    """Every hundredth turn asks: its mode, window, scope and exclusions follow from its marks."""
    k, c, none = F.col("k"), F.col("conversation"), F.lit(None).cast("array<long>")
    return memory.where("id % 100 = 0").select(
        F.col("id").alias("query_id"), "vector", F.element_at(F.array(*map(F.lit, MODES)), (k % 4 + 1).cast("int")).alias("mode"), (F.col("us") - 5 * DAY_US).alias("t0"), (F.col("us") + 5 * DAY_US).alias("t1"),
        (F.col("topic") == "view").alias("creative"), F.when(k % 5 == 0, F.array(c, c + 1, c + 2)).otherwise(none).alias("conversations"), F.when(k % 3 == 0, F.array(c + 1, c + 3)).otherwise(none).alias("excluded"),
        F.when(k % 7 == 0, F.array(*[F.lit(n).cast("long") for n in (1, 4)])).otherwise(none).alias("clusters"), F.when(k % 2 == 0, F.array(F.lit(2).cast("long"))).otherwise(none).alias("excluded_clusters"),
        (k % 10 / 20).alias("topic_confidence"), (k % 7 / 20).alias("intent_confidence"),
    )


MEMORY_SQL = f"""{TURNS_SQL}, m AS (SELECT turns.*, embedding::DOUBLE[] AS e FROM turns JOIN embeddings ON vec_id = turn_id),
a AS (SELECT turn_id AS query_id, e AS qe, ['current', 'as_of', 'range', 'evolution'][k % 4 + 1] AS mode, us - {5 * DAY_US} AS t0, us + {5 * DAY_US} AS t1, topic = 'view' AS creative, CASE WHEN k % 5 = 0 THEN [conversation_id, conversation_id + 1, conversation_id + 2] END AS convs,
  CASE WHEN k % 3 = 0 THEN [conversation_id + 1, conversation_id + 3] END AS excl, CASE WHEN k % 7 = 0 THEN [1, 4] END AS clus, k % 2 = 0 AS not2, k % 10 / 20 AS tc, k % 7 / 20 AS ic FROM m WHERE turn_id % 100 = 0),
q AS (SELECT *, mode IN ('as_of', 'range') AS windowed, CASE mode WHEN 'as_of' THEN (t0 + t1) // 2 ELSE {NOW_US} END AS centre, CASE WHEN mode IN ('range', 'evolution') OR (creative AND mode = 'current') THEN 0 ELSE 0.25 END::DOUBLE AS boost FROM a)"""
SEEN_SQL = """((mode <> 'current' AND decay > 0) OR (NOT is_archived AND decay > 0.2)) AND (NOT windowed OR (us >= t0 AND us < t1)) AND CASE WHEN convs IS NULL THEN NOT is_private ELSE list_contains(convs, conversation_id) END
  AND (excl IS NULL OR NOT list_contains(excl, conversation_id)) AND (clus IS NULL OR cluster_id IS NULL OR list_contains(clus, cluster_id)) AND NOT (not2 AND coalesce(cluster_id = 2, false))"""
NEAR_SQL = "(1 + boost * exp(-abs(us - centre) / 86400000000 / 30.0::DOUBLE))"
FIRST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
TURN_LEG_SQL = f"""{MEMORY_SQL}, s AS (SELECT query_id, mode, turn_id AS id, us, round(list_cosine_similarity(qe, e) * decay * {NEAR_SQL}, 6) AS score FROM q, m WHERE NOT is_document AND {SEEN_SQL}),
r AS (SELECT *, {FIRST} AS nth FROM s), n AS (SELECT * FROM r WHERE nth <= CASE mode WHEN 'evolution' THEN 300 ELSE 100 END),
era AS (SELECT *, floor((row_number() OVER (PARTITION BY query_id ORDER BY us, id) - 1) / ceil(count(*) OVER (PARTITION BY query_id) / 4.0)) AS era FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, era ORDER BY score DESC, id) AS best FROM era),
tl AS (SELECT query_id, id, score, {FIRST}::INT AS rank FROM b WHERE mode <> 'evolution' OR best <= 3)"""


@add(f"WITH {TURN_LEG_SQL} SELECT * FROM tl")
def turn_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg: what each query may see of all turns, by cosine, decay and nearness in time."""
    m = memory(spark, sf_dir)
    return legs.turn_leg(m, asked(m), NOW_US)


@add(f"""WITH {TURN_LEG_SQL}, c AS (SELECT query_id, vec_id AS id, turn_id AS parent, round(list_cosine_similarity(qe, embedding::DOUBLE[]) * decay * {NEAR_SQL}, 6) AS score FROM embeddings JOIN turns ON turn_id = vec_id // 4, q WHERE {SEEN_SQL}),
cr AS (SELECT *, {FIRST} AS nth FROM c), cc AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent ORDER BY score DESC, id) AS of_parent FROM cr WHERE nth <= 30)
SELECT query_id, id, parent, score, {FIRST}::INT AS rank FROM cc WHERE of_parent <= 3 AND NOT EXISTS (FROM tl WHERE tl.query_id = cc.query_id AND tl.id = cc.parent)""")
def chunk_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks, four a turn: seen as their turns are, and left out where the turn itself was found."""
    m = memory(spark, sf_dir)
    q = asked(m)
    chunks = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("parent"), F.col("embedding").alias("vector"))
    return legs.chunk_leg(chunks, m, q, legs.turn_leg(m, q, NOW_US), NOW_US)


@add(f"""WITH {MEMORY_SQL}, w AS (SELECT q.*, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda w: length(w) > 6)))[1:6] AS kw FROM q LEFT JOIN documents ON doc_id = query_id),
c AS (SELECT turns.*, text, CASE WHEN turn_id % 3 > 0 THEN embedding::DOUBLE[] END AS e FROM turns JOIN documents ON doc_id = turn_id LEFT JOIN embeddings ON vec_id = turn_id),
d AS (SELECT query_id, turn_id AS id, us, CASE WHEN e IS NULL THEN 1.0::DOUBLE ELSE round(1 - round(list_cosine_similarity(qe, e), 6), 6) END AS distance FROM w, c WHERE windowed AND us >= t0 AND us < t1
  AND CASE WHEN convs IS NULL THEN NOT is_private ELSE list_contains(convs, conversation_id) END AND (excl IS NULL OR NOT list_contains(excl, conversation_id))
  AND (e IS NOT NULL OR len(kw) = 0 OR len(list_filter(kw, lambda w: contains(lower(coalesce(text, '')), w))) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, us DESC, id)::INT AS rank FROM d) SELECT query_id, id, distance, 0.6::DOUBLE AS score, rank FROM r WHERE rank <= 5""")
def cold_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the cold store's texts, two of three with a vector; windowed queries ask with long words of their own text."""
    m, docs = memory(spark, sf_dir), read(spark, sf_dir, "documents")
    words = F.slice(F.array_sort(F.array_distinct(F.filter(tx.letters(F.col("text")), lambda w: F.length(w) > 6))), 1, 6)
    q = asked(m).withColumn("t0", F.when(F.col("mode").isin("as_of", "range"), F.col("t0"))).join(docs.select(F.col("doc_id").alias("query_id"), words.alias("keywords")), "query_id", "left")
    q = q.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    v = read(spark, sf_dir, "embeddings").where("vec_id % 3 > 0").select(F.col("vec_id").alias("turn_id"), F.col("embedding").alias("vector"))
    rows = turns(spark, sf_dir).join(docs.select(F.col("doc_id").alias("turn_id"), "text"), "turn_id").join(v, "turn_id", "left")
    cold = rows.select(F.col("turn_id").alias("id"), "vector", "us", F.col("conversation_id").alias("conversation"), "is_private", "text")
    return legs.cold_leg(cold, q, NOW_US)


@add(f"""WITH {MEMORY_SQL}, s AS (SELECT query_id, turn_id AS id, round(list_cosine_similarity(qe, e) * {NEAR_SQL}, 6) AS score FROM q, m WHERE tc < 0.35 AND ic < 0.35 AND {SEEN_SQL}),
r AS (SELECT *, {FIRST}::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 100""")
def wide_net_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the queries whose topic and intent are both unsure search instead."""
    m = memory(spark, sf_dir)
    return legs.wide_net(m, asked(m), NOW_US)


WINDOW = (ORDERS_NOW_US - 900 * DAY_US, ORDERS_NOW_US - 600 * DAY_US)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges between customers and parts (these above a million), anchors, queries and denied parts: every hundredth customer asks for itself and the next one."""
    e = edges(spark, sf_dir).withColumn("target", F.col("target") + 1_000_000)
    c = F.col("c_custkey")
    q = read(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(
        c.alias("query_id"), F.element_at(F.array(*map(F.lit, MODES)), (c / 100 % 4 + 1).cast("int")).alias("mode"), F.lit(WINDOW[0]).alias("t0"), F.lit(WINDOW[1]).alias("t1"),
        F.when(c % 300 != 0, F.sequence(F.lit(0), F.lit(60))).alias("batches"), F.array(F.lit(5), F.lit(7)).alias("denied"),
    )
    windowed = F.col("mode").isin("as_of", "range")
    q = q.withColumns({"batches": F.col("batches").cast("array<long>"), "denied": F.col("denied").cast("array<long>"), "t0": F.when(windowed, F.col("t0")), "t1": F.when(windowed, F.col("t1"))})
    nth = F.posexplode(F.array(F.col("query_id"), F.col("query_id") + 1)).alias("nth", "anchor")
    anchors = q.select("query_id", nth).withColumn("relations", F.when(F.col("query_id") % 200 == 0, F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).otherwise(F.array().cast("array<string>")))
    known = read(spark, sf_dir, "customer").select(c.alias("anchor"))
    denied = q.crossJoin(F.broadcast(spark.range(0, 10).select((F.col("id") * 7 + 1_000_001).alias("node")))).select("query_id", "node")  # ten stated parts
    return e, anchors.join(known, "anchor"), q, denied


GRAPH_SQL = f"""{EDGES_SQL}, q AS (SELECT *, mode IN ('as_of', 'range') AS win FROM (SELECT c_custkey AS query_id, ['current', 'as_of', 'range', 'evolution'][c_custkey // 100 % 4 + 1] AS mode, c_custkey % 300 <> 0 AS part_ FROM customer WHERE c_custkey % 100 = 0)),
w AS (SELECT *, CASE WHEN win THEN {WINDOW[0]} END AS t0, CASE WHEN win THEN {WINDOW[1]} END AS t1 FROM q), an AS (SELECT query_id, c_custkey AS anchor, (c_custkey - query_id)::INT AS nth FROM w JOIN customer ON c_custkey IN (query_id, query_id + 1)),
o AS (SELECT edge_id, source AS node, target + 1000000 AS other, true AS outgoing, relation, strength, confidence, negated, valid_from, valid_until, batch FROM edges UNION ALL SELECT edge_id, target + 1000000, source, false, relation, strength, confidence, negated, valid_from, valid_until, batch FROM edges),
b AS (SELECT query_id, mode, o.*, strength * coalesce(confidence, 1) * (1 + 0.3 * exp(-abs(CASE WHEN win THEN valid_from ELSE least(valid_from, {ORDERS_NOW_US}) END - coalesce(t1, {ORDERS_NOW_US})) / 86400000000 / 30.0::DOUBLE)) AS trust FROM w, o
  WHERE CASE WHEN win THEN valid_from <= t1 AND (valid_until IS NULL OR valid_until > t1) ELSE valid_until IS NULL END AND (NOT part_ OR batch <= 60) AND batch NOT IN (5, 7)),
no AS (SELECT query_id, anchor AS node FROM an UNION SELECT query_id, i * 7 + 1000001 FROM w, range(10) t(i)), d1 AS (SELECT DISTINCT query_id, node, other FROM b WHERE NOT negated AND trust >= 0.5 AND (query_id, other) NOT IN (FROM no)), d2 AS (SELECT DISTINCT query_id, node, other FROM b WHERE NOT negated AND trust >= 1 AND (query_id, other) NOT IN (FROM no)),
h0 AS (SELECT query_id, anchor, anchor AS node, 0 AS depth FROM an), h1 AS (SELECT DISTINCT query_id, anchor, other AS node, 1 AS depth FROM h0 JOIN d1 USING (query_id, node)),
h2 AS (SELECT DISTINCT query_id, anchor, other AS node, 2 AS depth FROM h1 JOIN d2 USING (query_id, node) WHERE NOT EXISTS (FROM h1 x WHERE x.query_id = h1.query_id AND x.anchor = h1.anchor AND x.node = other)),
h3 AS (SELECT DISTINCT query_id, anchor, other AS node, 3 AS depth FROM h2 JOIN d2 USING (query_id, node) WHERE NOT EXISTS (FROM (FROM h1 UNION ALL FROM h2) x WHERE x.query_id = h2.query_id AND x.anchor = h2.anchor AND x.node = other)),
walk AS (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3)"""


@add(f"WITH {GRAPH_SQL} SELECT * FROM walk")
def scoped_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hundredth customer and its neighbour reach in three hops, in their window, batches and without denied parts."""
    e, anchors, q, denied = _graph(spark, sf_dir)
    return legs.scoped_walk(e, anchors, q, ORDERS_NOW_US, denied)


_LINE = "CASE WHEN negated THEN 'not ' ELSE '' END || CASE WHEN outgoing THEN '-> ' ELSE '<- ' END || relation || ' ' || other"
_DAY = "strftime(make_timestamp({0}), '%Y-%m-%d')"


@add(f"""WITH {GRAPH_SQL}, l AS (SELECT an.query_id, anchor, nth, b.* EXCLUDE (query_id), {_LINE} AS line, row_number() OVER (PARTITION BY an.query_id, anchor ORDER BY strength DESC, edge_id, outgoing DESC) AS at_ FROM an JOIN b ON b.query_id = an.query_id AND b.node = anchor),
note AS (SELECT query_id, anchor, string_agg(line, chr(10) ORDER BY at_) AS note FROM l WHERE at_ <= 20 GROUP BY ALL), mean AS (SELECT query_id, anchor, avg(trust) AS mean FROM l WHERE NOT negated AND trust >= 0.5 GROUP BY ALL),
fa AS (SELECT *, row_number() OVER (PARTITION BY query_id, anchor ORDER BY strength DESC, edge_id, outgoing DESC) AS f FROM l WHERE query_id % 200 = 0 AND relation IN ('1-URGENT', '5-LOW')),
fact AS (SELECT query_id, anchor, string_agg('fact ' || line, chr(10) ORDER BY f) AS facts FROM fa WHERE f <= 10 AND trust >= 0.5 GROUP BY ALL), n AS (SELECT query_id, anchor, count(*) - 1 AS reached FROM walk GROUP BY ALL),
g AS (SELECT an.*, reached, round(1 + least(0.5, 0.25 * coalesce(mean, 0)) + CASE WHEN facts IS NOT NULL THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score, concat_ws(chr(10), '# ' || anchor, note, facts) AS text FROM an JOIN n USING (query_id, anchor) LEFT JOIN mean USING (query_id, anchor) LEFT JOIN note USING (query_id, anchor) LEFT JOIN fact USING (query_id, anchor)),
own AS (SELECT an.query_id, anchor, t0, t1, mode, o.*, {_DAY.format('valid_from')} || ' to ' || coalesce({_DAY.format('valid_until')}, 'now') || ' ' || {_LINE} AS line FROM an JOIN w USING (query_id) JOIN o ON node = anchor WHERE NOT part_ OR batch <= 60),
past AS (SELECT DISTINCT query_id, anchor, mode FROM own WHERE valid_until IS NOT NULL), c AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY nth, anchor) AS place, mode FROM g JOIN past USING (query_id, anchor)),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, anchor ORDER BY valid_from DESC, edge_id DESC, outgoing) AS back FROM own WHERE (t1 IS NULL OR valid_from <= t1) AND (t0 IS NULL OR valid_until IS NULL OR valid_until > t0)),
tl AS (SELECT query_id, anchor, string_agg(line, chr(10) ORDER BY back DESC) AS text FROM m WHERE back <= 8 GROUP BY ALL)
SELECT query_id, 'codex' AS leg, anchor, score, reached, text FROM g UNION ALL SELECT query_id, 'timeline', anchor, round(0.9 * score, 6)::DOUBLE, reached, tl.text FROM c JOIN tl USING (query_id, anchor) WHERE place <= CASE mode WHEN 'evolution' THEN 4 ELSE 2 END""")
def graph_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and timelines of the same customers."""
    e, anchors, q, denied = _graph(spark, sf_dir)
    return legs.graph_fragments(e, anchors, q, legs.scoped_walk(e, anchors, q, ORDERS_NOW_US, denied), ORDERS_NOW_US)


@add(f"""WITH {MEMORY_SQL}, qt AS (SELECT DISTINCT query_id, term FROM (SELECT doc_id AS query_id, unnest(list_filter(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: length(w) > 2)[1:30], lambda w: w NOT IN ({STOP_SQL}))) AS term FROM documents)),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM dw),
dt AS (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM dw), tf AS (SELECT doc_id, size, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt JOIN q USING (query_id)) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
p AS (SELECT doc_id, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS part FROM tf JOIN df USING (term), st),
s AS (SELECT query_id, doc_id AS id, round(sum(part), 6) AS score FROM p JOIN qt USING (term) JOIN q USING (query_id) GROUP BY ALL), v AS (SELECT s.* FROM s JOIN q USING (query_id) JOIN turns ON turn_id = s.id WHERE {SEEN_SQL}),
r AS (SELECT *, {FIRST}::INT AS rank FROM v) SELECT * FROM r WHERE rank <= 100""")
def scoped_lexical_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the asking turns' texts among the texts that each of them may see."""
    docs = read(spark, sf_dir, "documents")
    q = asked(memory(spark, sf_dir)).join(docs.select(F.col("doc_id").alias("query_id"), tx.search_terms(F.col("text")).alias("terms")), "query_id")
    t = turns(spark, sf_dir).withColumn("clusters", F.array_compact(F.array("cluster_id"))).withColumnsRenamed({"turn_id": "id", "conversation_id": "conversation"})
    return recall.lexical_leg(lexical.index_of(docs), t, q, NOW_US)


INTENTS = ("Factual_Retrieval", "Ideation", "Code_Change", "Strategic_Planning")


@add()
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a prompt, each with its own scope, window, intents and budget; prompts that say nothing of their topic go by the wide net.

    Turns are events with the document and the vector of their id; a conversation's entity is the customer of its number, and orders are its edges.
    """
    docs, v = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    text = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    every = turns(spark, sf_dir).withColumn("clusters", F.array_compact(F.array("cluster_id"))).withColumnsRenamed({"turn_id": "id", "conversation_id": "conversation"}).join(text, "id")
    every = every.withColumns({"summary": tx.truncate_words(F.col("raw"), 60), "abstract": tx.truncate_words(F.col("raw"), 12), "inject_raw": F.col("is_bookmarked")})
    m = cut(memory(spark, sf_dir))
    k = F.col("k")
    said = docs.select(F.col("doc_id").alias("query_id"), tx.search_terms(F.col("text")).alias("terms"), tx.prompt_keywords(F.substr("text", F.lit(1), F.lit(200))).alias("keywords"))
    length = every.groupBy(F.col("conversation").alias("own")).agg(F.count("*").alias("n"), F.sum(tx.token_estimate(F.col("raw"))).alias("tokens"))
    marks = m.select(F.col("id").alias("query_id"), F.col("conversation").alias("own"), "k", F.array(F.element_at(F.array(*map(F.lit, INTENTS)), (k % 4 + 1).cast("int"))).alias("intents"), F.when(k % 3 == 0, F.array(F.lit("Software_&_Tech"))).otherwise(F.array().cast("array<string>")).alias("topics"))
    q = asked(m).join(marks, "query_id").join(said, "query_id").join(length, "own")
    whole = scalars.retrieval_budget(F.col("n"), F.col("tokens"), F.lit(23_000))["retrieval"]
    net = asm.wide_net_budget(F.col("topic_confidence"), F.col("intent_confidence"), whole)
    q = cut(q.withColumn("lost", net.isNotNull()).withColumn("budget", F.coalesce(net, whole)).withColumn("cold_words", F.slice(F.filter("keywords", lambda w: F.length(w) >= 3), 1, 6)))
    sure = q.where("not lost")

    near = cut(legs.turn_leg(m, sure, NOW_US))
    lexical_finds = cut(recall.lexical_leg(lexical.index_of(docs), every, sure, NOW_US))
    cold = every.where("is_archived").join(v, "id", "left").withColumn("text", F.col("raw"))
    cold_finds = cut(legs.cold_leg(cold, sure.withColumn("keywords", F.col("cold_words")).withColumn("t0", F.when(F.col("mode") != "evolution", F.col("t0"))), NOW_US))
    net_finds = cut(legs.wide_net(m, q, NOW_US))
    # four chunks a turn: its first hundred words, the next hundred and so on, each with a vector of its own
    chunks = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("parent"), F.col("embedding").alias("vector"))
    words = tx.words(F.col("raw"))
    part = F.array_join(F.slice(words, (F.col("id") % 4 * 100 + 1).cast("int"), 100), " ")
    of_chunk = legs.chunk_leg(chunks, m, sure, near, NOW_US).drop("score").join(text.withColumnRenamed("id", "parent"), "parent").withColumn("text", part)
    forms = cut(recall.turn_forms(near.select("query_id", "id").unionByName(lexical_finds.select("query_id", "id")).unionByName(cold_finds.select("query_id", "id")).unionByName(net_finds.select("query_id", "id")), every, q))

    e = edges(spark, sf_dir).withColumn("target", F.col("target") + 1_000_000)
    g = q.select("query_id", "mode", F.when(F.col("mode").isin("as_of", "range"), F.col("t0")).alias("t0"), F.when(F.col("mode").isin("as_of", "range"), F.col("t1")).alias("t1"), F.lit(None).cast("array<long>").alias("batches"), F.lit(None).cast("array<long>").alias("denied"))
    anchors = q.select("query_id", F.col("own").alias("anchor"), F.lit(0).alias("nth"), F.when(k % 2 == 0, F.array(F.lit("1-URGENT"))).otherwise(F.array().cast("array<string>")).alias("relations"))
    known = legs.graph_fragments(e, anchors, g, legs.scoped_walk(e, anchors, g, NOW_US), NOW_US).withColumnsRenamed({"anchor": "id", "leg": "of"})
    known = cut(known.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "id"))))

    patterns = vectors.block_topk(v.where("id % 4 > 0 and id % 10 >= 3"), sure, 5, "id", "vector", cosine=True).join(text, "id").withColumn("text", tx.truncate_words(F.col("raw"), 40))
    fires = asm.holds_any(F.col("text"), F.col("keywords")) & ~F.coalesce(F.arrays_overlap("excluded", F.array("conversation")), F.lit(False))
    gated = patterns.join(legs.small(sure.select("query_id", "keywords", "excluded")), "query_id").join(m.select("id", "conversation"), "id").where(fires)
    summaries = m.select("id", "vector", "conversation")
    brief = recall.summary_leg(summaries, sure).join(every.select("id", "summary", "conversation"), "id").withColumnRenamed("summary", "text")

    finds = recall.turn_finds("bm25", lexical_finds, forms)
    for part_ in (
        recall.turn_finds("vector", near, forms), recall.turn_finds("cold", cold_finds, forms), recall.turn_finds("fallback", net_finds, forms),
        recall.text_finds("vector", "chunk", of_chunk, origin=F.col("parent")),
        recall.text_finds("codex", "codex", known.where("of = 'codex'").join(sure.select("query_id"), "query_id", "left_semi")), recall.text_finds("timeline", "timeline", known.where("of = 'timeline'").join(sure.select("query_id"), "query_id", "left_semi")),
        recall.text_finds("fallback", "codex", known.where("of = 'codex'").join(q.where("lost"), "query_id", "left_semi")),
        recall.text_finds("procedural", "pattern", gated), recall.text_finds("batch_summary", "summary", brief, conversation=F.col("conversation")),
    ):
        finds = finds.unionByName(part_)
    shares = rt.newer_share(every.select("id", F.col("conversation").alias("conversation_id"), "us"))
    kept = recall.chosen(cut(finds), q, shares)
    return recall.within_budget(kept, q, v.select(F.col("id").alias("origin"), F.col("vector").alias("found")))
