"""Queries of the record-level rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import records as rc
from engram.plans.base import Plans
from engram.sources.driver import DAY_US, EDGES_SQL, NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
WS = r"[ \t\n\r\f\x0B]+"


@add("SELECT conv_id, turn, length(trim(text, ' ')) BETWEEN 12 AND 8000 AS usable, trim(text, ' ') = '' OR starts_with(upper(trim(text, ' ')), 'ERROR') OR length(trim(text, ' ')) < 5 AS failed FROM conversations")
def prompt_and_answer_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", rc.usable_prompt(t).alias("usable"), rc.failed_answer(t).alias("failed"))


@add(f"""WITH {TURNS_SQL}, t AS (SELECT turn_id, topic, CASE WHEN k % 3 = 0 THEN [] WHEN k % 3 = 1 THEN ['view', 'click'] ELSE ['error'] END AS pt, CASE WHEN k % 4 = 0 THEN ['I' || k % 5] ELSE [] END AS pi, ['I' || turn_id % 5] AS i FROM turns)
SELECT turn_id, (len(pt) = 0 OR list_has_any(pt, [topic])) AND (len(pi) = 0 OR list_has_any(pi, i)) AS fires FROM t""")
def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    empty = F.array().cast("array<string>")
    pt = F.when(k % 3 == 0, empty).when(k % 3 == 1, F.array(F.lit("view"), F.lit("click"))).otherwise(F.array(F.lit("error")))
    pi = F.when(k % 4 == 0, F.array(F.concat(F.lit("I"), k % 5))).otherwise(empty)
    return turns(spark, sf_dir).select("turn_id", rc.triggers(pt, pi, F.array("topic"), F.array(F.concat(F.lit("I"), F.col("turn_id") % 5))).alias("fires"))


@add(f"""WITH {TURNS_SQL}, e AS (SELECT turn_id % 900 AS entity, conversation_id, CASE WHEN k % 6 > 0 THEN turn_id % 70 END AS batch FROM turns),
b AS (SELECT DISTINCT batch FROM e WHERE conversation_id IN (SELECT c_custkey FROM customer WHERE c_custkey < 2) AND batch IS NOT NULL) SELECT DISTINCT entity FROM e WHERE batch IN (SELECT batch FROM b)""")
def graph_scope_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = turns(spark, sf_dir).select((F.col("turn_id") % 900).alias("entity"), "conversation_id", F.when(F.col("k") % 6 > 0, F.col("turn_id") % 70).alias("batch"))
    return rc.graph_scope(e, read(spark, sf_dir, "customer").where("c_custkey < 2").select(F.col("c_custkey").alias("conversation_id")))


@add("""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS key, 0 AS rank FROM part UNION ALL SELECT p_partkey, lower(p_brand || ' ' || p_size), 1 FROM part),
m(mention) AS (VALUES ('Red Widget '), ('brand#2 11'), ('nothing'), ('small ring')), h AS (SELECT mention, rank, id FROM m JOIN n ON n.key = lower(trim(mention, ' ')))
SELECT mention, arg_min(id, (rank, id)) AS entity_id FROM h GROUP BY 1""")
def entity_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", "p_size")).alias("aliases"))
    m = spark.createDataFrame([("Red Widget ",), ("brand#2 11",), ("nothing",), ("small ring",)], "mention string")
    return rc.match_names(e, m)


@add(rf"""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'The ' WHEN 1 THEN 'a  ' WHEN 2 THEN '"' ELSE '' END || p_name || CASE WHEN p_size % 3 = 0 THEN '!' ELSE '' END AS term, p_name || ' of brand' AS text FROM part),
n AS (SELECT p_partkey, text, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(term, ' ')), '^(?:the|a|an)\s+', ''), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '\s+', ' ', 'g'), ' ') AS term FROM t)
SELECT p_partkey, term, len(list_filter(string_split_regex(term, '{WS}'), lambda w: NOT list_contains(string_split_regex(lower(text), '{WS}'), w))) = 0 AS grounded FROM n""")
def term_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    head = F.when(s % 4 == 0, "The ").when(s % 4 == 1, "a  ").when(s % 4 == 2, '"').otherwise("")
    term = F.concat(head, F.col("p_name"), F.when(s % 3 == 0, "!").otherwise(""))
    rows = read(spark, sf_dir, "part").select("p_partkey", term.alias("t"), F.concat("p_name", F.lit(" of brand")).alias("text"))
    return rows.select("p_partkey", rc.normalise_term(F.col("t")).alias("term"), rc.grounded(F.col("t"), F.col("text")).alias("grounded"))


VOCABULARY = ["works_at", "knows", "use", "part_of", "lives_in"]
SURFACES = ["Works at", "know", "using", "used", "is part of", "lives-in", "likes"]


@add(f"""WITH s AS (SELECT event_id, {SURFACES}[event_id % 7 + 1] AS surface FROM events), l AS (SELECT event_id, regexp_replace(lower(trim(surface, ' ')), '[\\s-]+', '_', 'g') AS low FROM s),
f AS (SELECT event_id, [low, regexp_replace(low, '(?:s|ed|ing)$', ''), regexp_replace(low, '^(?:is|was|are)_', ''), low || 's'] AS forms FROM l)
SELECT event_id, list_filter(forms, lambda x: list_contains({VOCABULARY}, x))[1] AS relation FROM f""")
def relation_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    surface = F.element_at(F.array(*map(F.lit, SURFACES)), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", rc.normalise_relation(surface, VOCABULARY).alias("relation"))


@add(f"""WITH {TURNS_SQL}, r AS (SELECT (turn_id * 7) % 2000 AS turn_id, count(*) AS n FROM turns WHERE k < 30 GROUP BY 1)
SELECT t.turn_id, round(least(1.0, decay + 0.15 * n), 6) AS decay, (accesses + n)::BIGINT AS accesses FROM turns t JOIN r USING (turn_id)""")
def strengthen_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return rc.strengthen(t, t.where("k < 30").select((F.col("turn_id") * 7 % 2000).alias("turn_id")))


@add(f"""WITH {EDGES_SQL}, u AS (SELECT DISTINCT edge_id FROM edges WHERE target % 5 = 0) SELECT edge_id, round(least(10.0, strength + 0.15), 6) AS strength,
least(10.0, strength + 0.15) >= 2 AND coalesce(confidence, 1) >= 0.5 AS promoted FROM edges JOIN u USING (edge_id)""")
def reinforce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return rc.reinforce(e, e.where("target % 5 = 0").select("edge_id"))


@add(f"""WITH {TURNS_SQL}, c AS (SELECT turn_id, CASE WHEN k % 8 > 0 THEN conversation_id END AS conv, decay FROM turns WHERE is_archived)
SELECT turn_id, decay::DOUBLE AS decay, 'hot' AS store FROM turns WHERE NOT is_archived UNION ALL SELECT turn_id, CASE WHEN turn_id % 3 = 0 AND conv IS NOT NULL THEN 0.12 ELSE decay END, CASE WHEN turn_id % 3 = 0 AND conv IS NOT NULL THEN 'hot' ELSE 'cold' END FROM c""")
def cold_resurrection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    cold = t.where("is_archived").withColumn("conversation_id", F.when(F.col("k") % 8 > 0, F.col("conversation_id")))
    return rc.resurrect(t.where("not is_archived"), cold, cold.where("turn_id % 3 = 0"))


@add(f"""WITH {TURNS_SQL}, r AS (SELECT conversation_id, turn_id, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, turn_id DESC)::INT AS rank FROM turns WHERE is_bookmarked) SELECT * FROM r WHERE rank <= 3""")
def recent_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.newest(turns(spark, sf_dir), 3, F.col("is_bookmarked"))


@add(f"""WITH {TURNS_SQL}, a AS (SELECT c_custkey AS query_id, c_custkey AS conv, {NOW_US - 8 * DAY_US} + c_custkey % 5 * {DAY_US} AS t0, {NOW_US - 8 * DAY_US} + (c_custkey % 5) * {DAY_US} + {DAY_US // 4} AS t1 FROM customer),
e AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM turns WHERE conversation_id = conv AND us >= t0 AND us < t1)),
n AS (SELECT query_id, us, row_number() OVER (PARTITION BY query_id ORDER BY least(abs(us - t0), abs(us - t1)), turn_id) AS nth FROM e JOIN turns ON conversation_id = conv)
SELECT query_id, array_to_string(list_sort(list(DISTINCT floor(us / {DAY_US})::BIGINT)), ',') AS days FROM n WHERE nth <= 3 GROUP BY 1""")
def empty_window_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    start = F.lit(NOW_US - 8 * DAY_US) + c % 5 * DAY_US
    asked = read(spark, sf_dir, "customer").select(c.alias("query_id"), c.alias("conv"), start.alias("t0"), (start + DAY_US // 4).alias("t1"))
    return rc.months_note(turns(spark, sf_dir), asked)


@add(f"WITH {TURNS_SQL} SELECT conversation_id, arg_max(topic, (us, turn_id)) AS topic, count(*) AS n FROM turns GROUP BY 1 HAVING n >= 10")
def reflection_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.latest_per(turns(spark, sf_dir), "conversation_id", ["us", "turn_id"], "topic").where("n >= 10")


@add(f"""WITH {TURNS_SQL}, v AS (SELECT conversation_id AS entity, topic AS kind, count(*) AS n FROM turns GROUP BY ALL) SELECT entity, arg_min(kind, (-n, kind)) AS kind FROM v GROUP BY 1""")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.infer_types(turns(spark, sf_dir).select(F.col("conversation_id").alias("entity"), F.col("topic").alias("kind")))


@add(f"""WITH {TURNS_SQL} SELECT turn_id AS run_id, CASE WHEN k % 3 = 0 AND {NOW_US} - us > 600000000 THEN 'aborted' WHEN k % 3 = 0 THEN 'running' ELSE 'done' END AS status FROM turns""")
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = turns(spark, sf_dir).select(F.col("turn_id").alias("run_id"), F.when(F.col("k") % 3 == 0, "running").otherwise("done").alias("status"), F.col("us").alias("heartbeat_us"))
    return rc.run_status(r, NOW_US)


@add("""SELECT doc_id, round(least(1.0, CASE WHEN contains(lower(text), 'thtion') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'ung') THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 0.3 ELSE 0 END), 6)::DOUBLE AS density FROM documents""")
def keyword_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", rc.keyword_density(F.col("text"), {"thtion": 0.5, "ung": 0.4, "que": 0.3}).alias("density"))


@add(f"""WITH {TURNS_SQL}, c AS (SELECT conversation_id, min(us) AS created FROM turns GROUP BY 1)
SELECT t.conversation_id AS conv, turn_id AS turn, row_number() OVER (ORDER BY created, t.conversation_id, us, turn_id) AS position FROM turns t JOIN c USING (conversation_id)""")
def conversation_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.stitch(turns(spark, sf_dir).select(F.col("conversation_id").alias("conv"), F.col("turn_id").alias("turn"), "us"))


@add("""WITH p AS (SELECT event_id AS a, event_id + 1 AS b, (event_id % 30) / 100.0::DOUBLE + 0.7 AS score, event_id % 2 = 0 AS same_type, event_id % 5 > 2 AS shared FROM events)
SELECT a, b, CASE WHEN score >= 0.95 AND same_type THEN 'duplicate' WHEN score >= 0.85 AND shared THEN 'supersede' ELSE 'queue' END AS verdict FROM p""")
def decision_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    p = read(spark, sf_dir, "events").select(e.alias("a"), (e + 1).alias("b"), (e % 30 / 100 + 0.7).alias("score"), (e % 2 == 0).alias("same_type"), (e % 5 > 2).alias("shared_files"))
    return rc.decide_duplicates(p)


@add("""WITH l AS (SELECT event_id % 500 AS doc_id, count(*) AS n_sections, bool_or(user_id % 2 = 0) AS enabled_here FROM events GROUP BY 1)
SELECT d.doc_id, coalesce(n_sections, 0) AS n_sections, coalesce(enabled_here, false) AS enabled_here FROM documents d LEFT JOIN l USING (doc_id)""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").groupBy((F.col("event_id") % 500).alias("doc_id")).agg(F.count("*").alias("n_sections"), F.bool_or(F.col("user_id") % 2 == 0).alias("enabled_here"))
    joined = read(spark, sf_dir, "documents").select("doc_id").join(s, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), F.coalesce("enabled_here", F.lit(False)).alias("enabled_here"))


@add("""SELECT event_id, least(coalesce(CASE WHEN user_id % 3 > 0 THEN user_id * 100 END, event_id * 10), coalesce(CASE WHEN user_id % 4 > 0 THEN 8192 END, CASE WHEN user_id % 3 > 0 THEN user_id * 100 END, event_id * 10))::BIGINT AS window_tokens FROM events""")
def observed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.functions.scalars import observed_window as window

    u, e = F.col("user_id"), F.col("event_id")
    made = window(F.when(u % 3 > 0, u * 100), e * 10, F.when(u % 4 > 0, F.lit(8192)))
    return read(spark, sf_dir, "events").select("event_id", made.cast("long").alias("window_tokens"))
