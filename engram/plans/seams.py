"""Queries of what is around a model: inputs, replies, conflicts, and the store's remaining upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import relations
from engram.operators import seams as sm
from engram.plans.base import Plans
from engram.sources.driver import EDGES_SQL, NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
WS = "[ \\t\\n\\r\\f\\x0B]+"


@add("""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN (event_id * 37 % 101) / 100.0::DOUBLE ELSE 0 END AS m, (user_id * 53 % 101) / 100.0::DOUBLE AS r FROM events),
z AS (SELECT *, 1 - greatest(m, r) AS z FROM e)
SELECT event_id, CASE WHEN z >= m AND z >= r THEN 'Zero_Shot' WHEN m >= r THEN 'Long_Term_Memory' ELSE 'Real_Time_Search' END AS label, m AS p_ltm, r AS p_rts,
round(greatest(z, m, r) - list_reverse_sort([z, m, r])[2], 6) AS confidence FROM z""")
def context_reliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = lambda c, k: F.col(c) * k % 101 / F.lit(100.0)
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 > 0, chance("event_id", 37)).alias("m"), chance("user_id", 53).alias("r"))
    rows = e.select("event_id", sm.context_reliance(F.col("m"), F.col("r")).alias("c")).select("event_id", "c.*")
    return rows.withColumn("confidence", F.round("confidence", 6))


TOPICS = ["code", "plans", "people", "places", "money", "health"]


@add(f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: x::DOUBLE) AS p FROM embeddings),
t AS (SELECT vec_id, p, list_transform(list_filter(list_zip({TOPICS}, p), lambda x: x[2] > 0.12), lambda x: x[1]) AS above FROM v)
SELECT vec_id, array_to_string(CASE WHEN len(above) > 0 THEN above ELSE [{TOPICS}[list_position(p, list_max(p))]] END, ',') AS tags FROM t""")
def threshold_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.slice(F.col("embedding"), 1, len(TOPICS)).cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(sm.tags_above(TOPICS, p, 0.12), ",").alias("tags"))


@add("""WITH e AS (SELECT event_id, ['t' || event_id % 4, 'i' || user_id % 3] AS tags, CASE WHEN event_id % 3 = 0 THEN ['c' || user_id % 4] ELSE [] END AS ctx, CASE WHEN event_id % 5 > 0 THEN 'c' || event_id % 3 END AS single, event_id % 2 + 1 AS version FROM events),
f AS (SELECT *, list_has_any(ctx, ['c0', 'c1']) AS has FROM e), g AS (SELECT *, CASE WHEN has THEN ctx WHEN version >= 2 THEN [] ELSE [single] END AS found FROM f)
SELECT event_id, array_to_string(list_transform(['t0', 't1', 't2', 'i0', 'i1'], lambda x: list_contains(tags, x)::INT) || list_transform(['c0', 'c1'], lambda x: coalesce(list_contains(found, x), false)::INT), '') AS labels,
coalesce(has OR version >= 2 OR single IN ('c0', 'c1'), false) AS mask FROM g""")
def multi_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    ctx = F.when(i % 3 == 0, F.array(F.concat(F.lit("c"), u % 4))).otherwise(F.array().cast("array<string>"))
    made = sm.label_row([["t0", "t1", "t2"], ["i0", "i1"]], ["c0", "c1"], F.array(F.concat(F.lit("t"), i % 4), F.concat(F.lit("i"), u % 3)), ctx, F.when(i % 5 > 0, F.concat(F.lit("c"), i % 3)), i % 2 + 1)
    return read(spark, sf_dir, "events").select("event_id", made.alias("m")).select("event_id", F.array_join(F.transform("m.labels", lambda x: x.cast("string")), "").alias("labels"), "m.mask")


@add(rf"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g'), ' ') AS text FROM conversations), w AS (SELECT *, string_split(text, ' ') AS words FROM s),
c AS (SELECT conv_id, turn, CASE WHEN len(words) > 20 THEN array_to_string(words[1:20], ' ') || '…' ELSE text END AS own, least(len(words), 20) AS n FROM w),
l AS (SELECT conv_id, turn, coalesce(lag(own, 3) OVER o, '') AS t3, lag(n, 3) OVER o AS n3, coalesce(lag(own, 2) OVER o, '') AS t2, lag(n, 2) OVER o AS n2, coalesce(lag(own, 1) OVER o, '') AS t1, lag(n, 1) OVER o AS n1 FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT *, CASE WHEN t3 = '' THEN 0 ELSE n3 END AS a, CASE WHEN t2 = '' THEN 0 ELSE n2 END AS b, CASE WHEN t1 = '' THEN 0 ELSE n1 END AS d FROM l)
SELECT conv_id AS conversation, turn AS exchange, concat_ws(chr(10), nullif(t3, ''), CASE WHEN t2 = '' THEN NULL WHEN a + b <= 45 THEN t2 WHEN 45 - a > 4 THEN array_to_string(string_split(t2, ' ')[1:45 - a], ' ') || '…' END,
CASE WHEN t1 = '' OR a + b > 45 THEN NULL WHEN a + b + d <= 45 THEN t1 WHEN 45 - a - b > 4 THEN array_to_string(string_split(t1, ' ')[1:45 - a - b], ' ') || '…' END) AS context FROM k""")
def exchange_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("exchange"), "text")
    return sm.exchange_context(rows, 3, 20, 45, 4)


PROMPTS = ["Who inspired Ann?", "which parts does it USES, and contains", "is she married to him", "It was created by Bo.", "nothing here", "he lives in Rome and owns dogs!", "what does it depend on, and who managed her"]
VOCABULARY = sorted(relations.PROPERTIES | relations.MULTI_VALUED | relations.SINGLE_VALUED)
STEM = "CASE WHEN length({0}) > 4 THEN regexp_replace({0}, '(ing|ed|es|s)$', '') ELSE {0} END"


@add(rf"""WITH r AS (SELECT unnest({VOCABULARY}) AS relation), x AS (SELECT DISTINCT relation, {STEM.format('w')} AS stem FROM (SELECT relation, unnest(string_split(relation, '_')) AS w FROM r) WHERE w NOT IN {sm.EMPTY_WORDS}),
n AS (SELECT relation, count(*) AS needed FROM x GROUP BY 1), p AS (SELECT p_partkey AS prompt_id, lower({PROMPTS!r}[p_partkey % 7 + 1] || ' ' || p_type) AS text FROM part),
s AS (SELECT DISTINCT prompt_id, {STEM.format('w')} AS stem FROM (SELECT prompt_id, trim(unnest(string_split_regex(text, '{WS}')), '.,!?"''') AS w FROM p)),
h AS (SELECT prompt_id, relation, count(*) AS found FROM s JOIN x USING (stem) GROUP BY 1, 2) SELECT prompt_id, relation, 'words' AS how FROM h JOIN n USING (relation) WHERE found = needed""")
def relation_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PROMPTS)), (F.col("p_partkey") % 7 + 1).cast("int")), "p_type")
    return sm.detected_relations(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("prompt_id"), text.alias("text")))


_FACT = "'{\"subject\": \"The ' || p_name || '\", \"relation\": \"' || ['Uses', 'works at', 'is fond of', 'part-of', 'knows'][p_partkey % 5 + 1] || '\", \"object\": \"' || CASE WHEN p_partkey % 13 = 0 THEN 'Smile' WHEN p_partkey % 17 = 0 THEN p_name ELSE p_brand END || '\"' || CASE WHEN p_partkey % 4 = 0 THEN ', \"negated\": true' ELSE '' END || '}'"
REPLIES_SQL = f"""replies AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN 'no facts' ELSE '[' || {_FACT} || ']' END AS reply, CASE p_size % 3 WHEN 0 THEN [p_name, 'the ' || p_brand] WHEN 1 THEN [p_type] END AS entities,
lower('the ' || p_name) AS subject, trim(regexp_replace(lower(['Uses', 'works at', 'is fond of', 'part-of', 'knows'][p_partkey % 5 + 1]), '[^a-z0-9]+', '_', 'g'), '_') AS relation, ['Uses', 'works at', 'is fond of', 'part-of', 'knows'][p_partkey % 5 + 1] AS asked,
CASE WHEN p_partkey % 13 = 0 THEN 'smile' WHEN p_partkey % 17 = 0 THEN lower(p_name) ELSE lower(p_brand) END AS object, p_partkey % 4 = 0 AS negated, p_size % 3 AS k, p_partkey % 13 = 0 AS no_object, p_partkey % 13 > 0 AND p_partkey % 17 = 0 AS own FROM part WHERE p_partkey % 19 > 0)"""
KNOWN_SQL = ", ".join(f"'{r}'" for r in VOCABULARY)


def _replies(spark, sf_dir):
    p = F.col("p_partkey")
    relation = F.element_at(F.array(*map(F.lit, ["Uses", "works at", "is fond of", "part-of", "knows"])), (p % 5 + 1).cast("int"))
    object_ = F.when(p % 13 == 0, "Smile").when(p % 17 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    fact = F.to_json(F.array(F.struct(F.concat(F.lit("The "), "p_name").alias("subject"), relation.alias("relation"), object_.alias("object"), F.when(p % 4 == 0, F.lit(True)).alias("negated"))))
    k = F.col("p_size") % 3
    sure = F.when(k == 0, F.array("p_name", F.concat(F.lit("the "), "p_brand"))).when(k == 1, F.array("p_type"))
    return read(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 19 == 0, "no facts").otherwise(fact).alias("reply"), sure.alias("entities"))


@add(f"""WITH {REPLIES_SQL} SELECT subject, relation, object, negated, max(CASE k WHEN 2 THEN 0.7 WHEN 0 THEN 0.9 ELSE 0.35 END::DOUBLE) AS confidence FROM replies WHERE relation IN ({KNOWN_SQL}) AND NOT no_object AND NOT own GROUP BY 1, 2, 3, 4""")
def triple_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.triples(_replies(spark, sf_dir))[0]


@add(f"WITH {REPLIES_SQL} SELECT id, asked AS relation FROM replies WHERE relation NOT IN ({KNOWN_SQL})")
def extraction_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.triples(_replies(spark, sf_dir))[1]


@add("""SELECT event_id AS id, 'use ' || event_type AS decision, CASE WHEN event_id % 4 = 0 THEN '' ELSE repeat('because ', 130)[1:1000] END AS rationale, event_id % 2 = 0 AS cut,
CASE WHEN event_id % 2 = 0 THEN 'a1,a2,a3,a4,a5,a6' ELSE '' END AS alternatives, CASE WHEN event_id % 6 = 0 THEN 'incident' ELSE 'constraint' END AS type FROM events WHERE event_id % 3 < 2""")
def decision_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    reply = F.to_json(F.struct(
        F.when(i % 3 < 2, F.concat(F.lit(" use "), "event_type")).otherwise(" ").alias("decision"), F.when(i % 4 > 0, F.repeat(F.lit("because "), 130)).alias("rationale"),
        F.when(i % 2 == 0, F.array(*[F.lit(f"a{k}") for k in range(1, 8)])).alias("alternatives_rejected"), F.when(i % 6 == 0, "Incident").otherwise("idea").alias("type"),
    ))
    rows = sm.decisions(read(spark, sf_dir, "events").select(i.alias("id"), F.lit("constraint").alias("cue"), reply.alias("reply")))
    return rows.select("id", "decision", "rationale", (F.size("alternatives") == 6).alias("cut"), F.array_join("alternatives", ",").alias("alternatives"), "type")


@add(f"""WITH t AS (SELECT conv_id AS title, turn AS pos, role, text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS norm FROM conversations WHERE text IS NOT NULL),
d AS (SELECT title, pos, role, text, norm FROM t UNION ALL SELECT title, pos + 1000, role, text || '!', norm FROM t WHERE pos % 2 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY title, CASE WHEN norm = '' THEN '#' || pos ELSE norm END ORDER BY pos) AS nth FROM d)
SELECT title, pos, role, text, {NOW_US} - (row_number() OVER (PARTITION BY title ORDER BY pos DESC) - 1) * 60000000 AS us FROM f WHERE nth = 1""")
def raw_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as slices of raw dumps; every second turn comes again with the overlap."""
    t = read(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("title"), F.lit(NOW_US).alias("mtime_us"), F.col("turn").alias("pos"), "role", "text")
    again = t.where("pos % 2 = 0").withColumns({"pos": F.col("pos") + 1000, "text": F.concat("text", F.lit("!"))})
    return sm.joined_slices(t.unionByName(again))


@add(rf"""WITH m AS (SELECT source AS cluster, doc_id, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents)
SELECT cluster, string_agg(array_to_string(words[1:200], ' '), chr(10) || chr(10) ORDER BY doc_id) AS snippets FROM m WHERE nth <= 10 AND len(words) >= 20 GROUP BY 1""")
def naming_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.snippets(read(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").alias("id"), "text"))


PAIRS = (("1-URGENT", "5-LOW"), ("2-HIGH", "4-NOT SPECIFIED"))
CONFLICTS_SQL = f"""{EDGES_SQL}, live AS (SELECT edge_id AS e, source AS s, relation AS r, target AS t FROM edges WHERE valid_until IS NULL), n AS (SELECT edge_id AS id, source, target, relation, edge_id % 4 IN (0, 2) AS cue FROM edges WHERE valid_until IS NOT NULL),
o(relation, r) AS (VALUES ('1-URGENT', '5-LOW'), ('5-LOW', '1-URGENT'), ('2-HIGH', '4-NOT SPECIFIED'), ('4-NOT SPECIFIED', '2-HIGH')),
a AS (SELECT id, min(e) AS opposed FROM n JOIN o USING (relation) JOIN live ON s = source AND t = target AND live.r = o.r GROUP BY 1),
b AS (SELECT id, min(e) AS replaced FROM n JOIN live ON s = source AND r = relation AND t <> target WHERE cue AND relation IN ('1-URGENT', '3-MEDIUM') GROUP BY 1),
c AS (SELECT id, CASE WHEN opposed IS NOT NULL THEN 'antonym' ELSE 'supersession' END AS kind, coalesce(opposed, replaced) AS old_edge FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE coalesce(opposed, replaced) IS NOT NULL)"""


def _conflicts(spark, sf_dir):
    e = edges(spark, sf_dir)
    text = F.element_at(F.array(*map(F.lit, ["I no longer use it", "we talked", "They SWITCHED FROM it", "fine"])), (F.col("edge_id") % 4 + 1).cast("int"))
    new = e.where("valid_until is not null").select(F.col("edge_id").alias("id"), "source", "relation", "target", sm.has_supersession_cue(text).alias("cue"))
    return sm.conflicts(new, e.where("valid_until is null"), PAIRS, ("1-URGENT", "3-MEDIUM"))


@add(f"WITH {CONFLICTS_SQL} SELECT id, kind, old_edge FROM c")
def conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines as new facts against the open ones."""
    return _conflicts(spark, sf_dir)


@add(f"""WITH {CONFLICTS_SQL}, d AS (SELECT *, ['expire_old', 'keep_both', 'reject_new', 'perhaps', NULL][id % 5 + 1] AS decision FROM c)
SELECT id, kind = 'antonym' OR coalesce(decision, 'review') <> 'reject_new' AS write, CASE WHEN kind = 'antonym' OR decision = 'expire_old' THEN old_edge END AS expire,
kind <> 'antonym' AND coalesce(decision, 'review') NOT IN ('expire_old', 'keep_both', 'reject_new') AS review FROM d""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.element_at(F.array(*map(F.lit, ["expire_old", "keep_both", "reject_new", "perhaps", None])), (F.col("id") % 5 + 1).cast("int"))
    return sm.reconciled(_conflicts(spark, sf_dir).withColumn("decision", decided))


@add(f"""WITH {TURNS_SQL} SELECT turn_id AS id, us AS created_us FROM turns WHERE topic = 'error' AND k % 2 = 0 AND coalesce(CASE WHEN k % 3 > 0 THEN k % 4 END, 0) < 2 ORDER BY us, turn_id LIMIT 50""")
def leftover_reconciliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = turns(spark, sf_dir).select(
        F.col("turn_id").alias("id"), F.when(F.col("topic") == "error", "codex_reconciliation").otherwise("other").alias("kind"), F.when(k % 2 == 0, "pending").otherwise("resolved").alias("status"),
        F.when(k % 3 > 0, k % 4).alias("attempts"), F.col("us").alias("created_us"),
    )
    return sm.leftovers(rows).select("id", "created_us")


@add(f"""WITH {TURNS_SQL}, i AS (SELECT turn_id AS id, k % 7 AS priority, k % 2 = 0 AS model, ['apply', 'propose', 'none'][turn_id % 3 + 1] AS effect FROM turns ORDER BY k % 7, turn_id LIMIT 50),
m AS (SELECT *, model AND sum(model::INT) OVER (ORDER BY priority, id) > 15 AS no_model FROM i), n AS (SELECT *, sum((NOT no_model AND effect = 'apply')::INT) OVER (ORDER BY priority, id) AS a, sum((NOT no_model AND effect = 'propose')::INT) OVER (ORDER BY priority, id) AS p FROM m)
SELECT id, CASE WHEN no_model OR (effect = 'apply' AND a > 10) OR (effect = 'propose' AND p > 5) THEN 'skipped_cap' WHEN effect = 'apply' THEN 'applied' WHEN effect = 'propose' THEN 'proposed' ELSE 'none' END AS outcome FROM n""")
def agent_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    effect = F.element_at(F.array(F.lit("apply"), F.lit("propose"), F.lit("none")), (F.col("turn_id") % 3 + 1).cast("int"))
    return sm.agent_run(turns(spark, sf_dir).select(F.col("turn_id").alias("id"), (k % 7).alias("priority"), (k % 2 == 0).alias("needs_model"), effect.alias("effect")), most_decisions=15)


@add(f"""WITH {TURNS_SQL}, g AS (SELECT turn_id FROM turns WHERE is_archived AND decay < 0.05) SELECT 'add' AS action, turn_id FROM g WHERE turn_id % 4 > 0 UNION ALL SELECT 'delete', turn_id FROM g""")
def cold_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    new, gone = sm.cold_moves(t, t.where("turn_id % 4 = 0"))
    return new.select(F.lit("add").alias("action"), "turn_id").unionByName(gone.select(F.lit("delete").alias("action"), "turn_id"))


@add("""WITH r AS (SELECT source AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations), s AS (SELECT source AS kind, max(doc_id) // 2 AS last_id FROM documents GROUP BY 1)
SELECT r.kind, id, sha256(trim(text, ' ')) AS source FROM r LEFT JOIN s ON r.kind = s.kind WHERE (last_id IS NULL OR id > last_id) AND length(trim(text, ' ')) > 0""")
def reembed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and turns to encode anew; a run over documents has come half the way."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = read(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    stamps = d.groupBy("kind").agg(F.expr("max(id) div 2").alias("last_id"))
    return sm.to_reembed(d.unionByName(c), stamps).withColumn("source", F.sha2("source", 256))


@add(f"""WITH {TURNS_SQL}, g AS (SELECT k AS document, conversation_id, topic <> 'error' AS enabled, us, turn_id FROM turns), e AS (SELECT document, conversation_id, min(us) FILTER (enabled) AS first_us, arg_max(enabled, (us, turn_id)) AS now FROM g GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY first_us NULLS LAST, conversation_id) AS nth FROM e)
SELECT document, sum(now::INT)::BIGINT AS enabled_in, max(CASE WHEN nth = 2 THEN first_us END) AS shared_us FROM n GROUP BY 1""")
def document_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.col("k").alias("document"), F.col("conversation_id").alias("conversation"), (F.col("topic") != "error").alias("enabled"), "us", F.col("turn_id").alias("seq"))
    return sm.latched(rows)


@add("""WITH o AS (SELECT p_partkey AS canonical, p_type AS payload FROM part WHERE p_size % 5 > 0), n AS (SELECT p_partkey AS canonical, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE p_type END AS payload FROM part WHERE p_size % 3 > 0),
c AS (SELECT coalesce(o.canonical, n.canonical) AS canonical, CASE WHEN o.canonical IS NULL THEN 'insert' WHEN n.canonical IS NULL THEN 'delete' WHEN o.payload <> n.payload THEN 'update' END AS action FROM o FULL JOIN n ON o.canonical = n.canonical) SELECT * FROM c WHERE action IS NOT NULL""")
def symbol_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey").alias("canonical")
    return sm.symbol_changes(p.where("p_size % 5 > 0").select(key, F.col("p_type").alias("payload")), p.where("p_size % 3 > 0").select(key, F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("payload")))


@add("""SELECT p_brand AS project, sha1(string_agg(p_name || p_partkey || '|' || CASE WHEN p_size % 9 = 0 THEN -1 ELSE p_partkey * 7 END || '|' || CASE WHEN p_size % 9 = 0 THEN -1 ELSE p_size END, chr(10) ORDER BY p_name || p_partkey || '|')) AS digest FROM part GROUP BY 1""")
def edit_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.col("p_size") % 9 > 0
    return sm.edit_digests(read(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.when(there, F.col("p_partkey") * 7).alias("mtime"), F.when(there, F.col("p_size")).alias("size")))


@add(f"""WITH {TURNS_SQL}, t AS (SELECT conversation_id AS project, turn_id AS task, CASE topic WHEN 'error' THEN 'active' WHEN 'view' THEN 'pending' ELSE 'done' END AS status, us, ['c' || turn_id % 5] AS commits FROM turns),
b AS (SELECT project, arg_max(task, (status = 'active', us, task)) AS task, arg_max(commits, (status = 'active', us, task)) AS had FROM t WHERE status IN ('active', 'pending') GROUP BY 1), c AS (SELECT DISTINCT conversation_id AS project, 'c' || k % 7 AS commit FROM turns)
SELECT project, task, commit FROM c JOIN b USING (project) WHERE NOT list_contains(had, commit)""")
def commit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    status = F.when(F.col("topic") == "error", "active").when(F.col("topic") == "view", "pending").otherwise("done")
    tasks = t.select(F.col("conversation_id").alias("project"), F.col("turn_id").alias("task"), status.alias("status"), "us", F.array(F.concat(F.lit("c"), F.col("turn_id") % 5)).alias("commits"))
    return sm.commit_links(t.select(F.col("conversation_id").alias("project"), F.concat(F.lit("c"), F.col("k") % 7).alias("commit")), tasks)
