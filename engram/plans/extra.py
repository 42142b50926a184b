"""Queries of scope precedence, assembly, label building and the smaller retrieval rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import vectors
from engram.operators import extra as x
from engram.plans.base import Plans
from engram.plans.retrieve import RANK, SIM, V_SQL, _vectors
from engram.sources.driver import TURNS_SQL, read, turns

PLANS = Plans()
add = PLANS.add
WS = r"[ \t\n\r\f\x0B]+"


@add("""WITH t AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'none' ELSE 'auto' END AS mode, CASE WHEN event_id % 3 = 0 THEN [user_id, user_id + 1] ELSE [] END AS man, CASE WHEN event_id % 4 = 0 THEN [user_id + 2] ELSE [] END AS att,
CASE WHEN event_id % 5 = 0 THEN [user_id + 3, user_id + 4] ELSE [] END AS proj, [user_id + event_id % 4] AS ex FROM events),
h AS (SELECT *, CASE WHEN mode = 'none' THEN 'none' WHEN len(man) > 0 THEN 'manual' WHEN len(att) > 0 THEN 'attached' WHEN len(proj) > 0 THEN 'project' ELSE 'none' END AS how FROM t)
SELECT event_id, how, array_to_string(list_sort(list_filter(CASE how WHEN 'manual' THEN man WHEN 'attached' THEN att WHEN 'project' THEN proj END, lambda i: NOT list_contains(ex, i))), ',') AS ids FROM h""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    none = F.array().cast("array<bigint>")
    made = x.resolve_scope(
        F.when(u % 7 == 0, "none").otherwise("auto"), F.when(e % 3 == 0, F.array(u, u + 1)).otherwise(none), F.when(e % 4 == 0, F.array(u + 2)).otherwise(none),
        F.when(e % 5 == 0, F.array(u + 3, u + 4)).otherwise(none), F.array(u + e % 4),
    )
    rows = read(spark, sf_dir, "events").select("event_id", made.alias("s"))
    return rows.select("event_id", "s.how", F.array_join(F.transform("s.ids", lambda i: i.cast("string")), ",").alias("ids"))


@add(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, w AS word FROM (SELECT item_id, unnest(string_split_regex(lower(text), '{WS}')) AS w FROM benchmark) WHERE length(w) >= 4),
w AS (SELECT DISTINCT word FROM q), f AS (SELECT word, doc_id AS entity_id FROM w JOIN documents ON contains(lower(text), word)),
h AS (SELECT query_id, word, entity_id, nth FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY word ORDER BY entity_id) AS nth FROM f) USING (word)), c AS (SELECT query_id, entity_id, count(*) AS hits FROM h WHERE nth <= 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, entity_id) AS rank FROM c) SELECT query_id, entity_id, hits FROM r WHERE rank <= 2""")
def entity_match_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.functions import text as tx

    words = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(tx.words(F.lower("text"))).alias("word")).distinct()
    return x.payload_match(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.col("text").alias("payload")), words)


@add("""WITH m AS (SELECT p_size AS query_id, p_partkey AS place, p_name AS name, [p_brand, p_type] AS aliases FROM part),
t AS (SELECT query_id, place, unnest(list_concat([name], aliases)) AS term, unnest([0, 1, 2]) AS n FROM m), f AS (SELECT query_id, term, min((place, n)) AS at_ FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY at_, term) AS nth FROM f) SELECT query_id, string_agg(term, '|' ORDER BY nth) AS terms FROM r WHERE nth <= 8 GROUP BY 1""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    return x.expansion(m)


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, {SIM} AS score FROM q, v WHERE vec_id % 4 > 0 AND vec_id % 10 >= 3), r AS (SELECT *, {RANK} FROM s) SELECT query_id, id AS pattern_id, rank FROM r WHERE rank <= 5 AND id % 2 = 0""")
def procedural_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as patterns: active unless a multiple of 4, confidence in tenths; the gate passes even ids."""
    v, q = _vectors(spark, sf_dir)
    near = vectors.block_topk(v.where("vec_id % 4 > 0 and vec_id % 10 >= 3"), q, 5, "vec_id", "embedding")
    rows = near.select("query_id", F.col("id").alias("pattern_id"), "score", F.lit(True).alias("is_active"), F.lit(1.0).alias("confidence"))
    return x.procedural(rows, F.col("pattern_id") % 2 == 0)


@add(f"""WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'List all ' WHEN 1 THEN 'tell me of ' ELSE 'how many ' END || event_type || ' notes' AS prompt, [event_type, 'x'] AS tags, user_id FROM events)
SELECT event_id, (contains(lower(prompt), 'list all') OR contains(lower(prompt), 'how many') OR contains(lower(prompt), 'which of') OR contains(lower(prompt), 'every'))
AND list_has_any(CASE WHEN user_id % 2 = 0 THEN tags ELSE ['y'] END, string_split_regex(lower(prompt), '{WS}')) AS enumerates FROM t""")
def enumeration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    prompt = F.concat(F.when(e == 0, "List all ").when(e == 1, "tell me of ").otherwise("how many "), F.col("event_type"), F.lit(" notes"))
    tags = F.when(F.col("user_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array(F.lit("y")))
    return read(spark, sf_dir, "events").select("event_id", x.enumeration(prompt, tags).alias("enumerates"))


@add("""SELECT request, block, sum(ceil(tokens * 1.2::DOUBLE)) OVER (PARTITION BY request ORDER BY priority, block, tokens ROWS UNBOUNDED PRECEDING) <= 300 AS kept
FROM (SELECT l_orderkey AS request, l_linenumber * 100000 + l_partkey * 10 + l_suppkey % 10 AS block, l_linenumber AS priority, l_quantity * 2 AS tokens FROM lineitem)""")
def context_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), block.alias("block"), F.col("l_linenumber").alias("priority"), (F.col("l_quantity") * 2).alias("tokens"))
    return x.fit_blocks(rows, 300)


@add("""WITH b AS (SELECT l_orderkey AS probe, avg(l_quantity) AS score FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1), m AS (SELECT o_orderkey AS probe, 3.0::DOUBLE AS score FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(b.probe, m.probe) AS probe, round(coalesce(m.score, b.score), 6) AS score, CASE WHEN m.score IS NOT NULL THEN 'manual' ELSE 'judged' END AS source FROM b FULL JOIN m ON b.probe = m.probe""")
def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("probe")).agg(F.avg("l_quantity").alias("score"))
    m = read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("probe"), F.lit(3.0).alias("score"))
    return x.override_merge(b, m, "probe").withColumn("score", F.round("score", 6))


@add("""WITH t AS (SELECT event_id, event_type = 'error' AS ctx FROM events), n AS (SELECT count(*) FILTER (ctx) AS flagged FROM t), o AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR), event_id) AS nth FROM t WHERE NOT ctx)
SELECT event_id FROM t WHERE ctx UNION ALL SELECT event_id FROM o, n WHERE nth <= floor(flagged * (1 - 0.45::DOUBLE) / 0.45::DOUBLE)""")
def ratio_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.ratio_compose(read(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "error", 0.45, "event_id").select("event_id")


@add("""WITH t AS (SELECT event_id, [CASE event_id % 3 WHEN 0 THEN 'Needs_Memory' WHEN 1 THEN 'Needs_Live' ELSE 'Zero_Shot' END, CASE WHEN user_id % 5 = 0 THEN 'Needs_Memory' ELSE 'Other' END] AS labels FROM events)
SELECT event_id, CASE WHEN list_contains(labels, 'Needs_Memory') THEN 'memory' WHEN list_contains(labels, 'Needs_Live') THEN 'live' ELSE 'none' END AS gold,
array_to_string([list_contains(labels, 'Needs_Memory')::INT, list_contains(labels, 'Needs_Live')::INT, list_contains(labels, 'Zero_Shot')::INT], '') AS hot FROM t""")
def gold_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 3
    labels = F.array(F.when(e == 0, "Needs_Memory").when(e == 1, "Needs_Live").otherwise("Zero_Shot"), F.when(F.col("user_id") % 5 == 0, "Needs_Memory").otherwise("Other"))
    return read(spark, sf_dir, "events").select("event_id", x.three_way(labels).alias("gold"), x.multi_hot(labels, ["Needs_Memory", "Needs_Live", "Zero_Shot"]).alias("hot"))


@add("""WITH m AS (SELECT c_custkey AS model, unnest(list_distinct([c_mktsegment, 'N' || c_nationkey % 4])) AS hub FROM customer), t(hub, tag) AS (VALUES ('HOUSEHOLD', 'Lifestyle'), ('MACHINERY', 'Tech'), ('N1', 'Tech'), ('N2', 'World'), ('N1', 'Code'))
SELECT model, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM m JOIN t USING (hub) GROUP BY 1""")
def model_tag_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model"), F.array("c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey") % 4)).alias("hub_tags"))
    t = spark.createDataFrame([("HOUSEHOLD", "Lifestyle"), ("MACHINERY", "Tech"), ("N1", "Tech"), ("N2", "World"), ("N1", "Code")], "hub string, tag string")
    return x.tag_sets(m, t)


@add("""WITH s AS (SELECT DISTINCT replace(p_brand, '#', '_') || '.' || p_type || '.f' || p_size AS symbol, replace(p_brand, '#', '_') || '.' || p_type AS module FROM part),
r AS (SELECT DISTINCT replace(p_brand, '#', '_') || '.' || p_type AS module, 'f' || p_partkey % 60 AS ref FROM part), o AS (SELECT module, ref, module || '.' || ref AS symbol FROM r WHERE module || '.' || ref IN (SELECT symbol FROM s)),
l AS (SELECT list_last(string_split(symbol, '.')) AS ref, min(symbol) AS symbol FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT module, ref, symbol, 1.0::DOUBLE AS confidence FROM o UNION ALL SELECT r.module, r.ref, l.symbol, 0.6 FROM r JOIN l USING (ref) WHERE (r.module, r.ref) NOT IN (SELECT module, ref FROM o)""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.concat(F.regexp_replace("p_brand", "#", "_"), F.lit("."), F.col("p_type"))
    p = read(spark, sf_dir, "part")
    symbols = p.select(F.concat(module, F.lit(".f"), F.col("p_size")).alias("symbol"), module.alias("module")).distinct()
    refs = p.select(module.alias("module"), F.concat(F.lit("f"), F.col("p_partkey") % 60).alias("ref")).distinct()
    return x.imports_resolved(refs, symbols)


@add("""WITH RECURSIVE v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.25),
r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT v.grp AS "group", v.id, CASE WHEN count(*) > 1 THEN min(b) END AS cluster FROM v JOIN r ON r.a = v.id GROUP BY 1, 2""")
def wait_for_a_friend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return x.friends(v, 0.25)


@add(f"""WITH {TURNS_SQL}, t AS (SELECT turn_id, 'fix in src/mod' || k % 9 || '.py now' AS task FROM turns), c AS (SELECT p_partkey AS constraint_id, 'src/mod' || p_partkey % 9 || '.py' AS file FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 9 ORDER BY p_partkey) <= 5),
h AS (SELECT turn_id, constraint_id, row_number() OVER (PARTITION BY turn_id ORDER BY constraint_id) AS nth FROM t JOIN c ON regexp_extract(task, '(src/[a-z0-9]+\\.py)', 1) = file) SELECT turn_id, constraint_id FROM h WHERE nth <= 5""")
def constraint_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints whose file a task names, the first five a task: paths are extracted, then an equi-join with the first five of each file."""
    from pyspark.sql import Window

    tasks = turns(spark, sf_dir).select("turn_id", F.concat(F.lit("fix in src/mod"), F.col("k") % 9, F.lit(".py now")).alias("task"))
    named = tasks.select("turn_id", F.explode(F.regexp_extract_all("task", F.lit(r"(src/[a-z0-9]+\.py)"), F.lit(1))).alias("file"))
    c = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("constraint_id"), F.concat(F.lit("src/mod"), F.col("p_partkey") % 9, F.lit(".py")).alias("file"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("constraint_id"))
    nth = F.row_number().over(Window.partitionBy("turn_id").orderBy("constraint_id"))
    return named.join(c.withColumn("first", first).where("first <= 5"), "file").withColumn("nth", nth).where("nth <= 5").select("turn_id", "constraint_id")
