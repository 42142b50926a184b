"""Queries of the store's upkeep: ledgers, entities, slots, reviews, deletion, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import relations
from engram.functions import text as tx
from engram.operators import maintain as mt
from engram.plans.base import Plans
from engram.plans.retrieve import V_SQL, _vectors
from engram.sources.driver import DAY_US, EDGES_SQL, NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
HASH = r"left(sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))), 20)"


@add(f"WITH h AS (SELECT doc_id, {HASH} AS hash FROM documents), l AS (SELECT DISTINCT hash FROM h WHERE doc_id % 7 = 0) SELECT min(doc_id) AS id, hash FROM h WHERE hash NOT IN (SELECT hash FROM l) GROUP BY hash")
def replay_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a replayed export; the ledger holds the hashes of every seventh."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.normalised_hash(F.col("text")).alias("hash"))
    return mt.not_in_ledger(rows, rows.where("id % 7 = 0").select("hash").distinct())


NAMES = ("Works At", "uses", "likes-a-lot", "status", "knows!", "is fond of")
_LIST = ", ".join(f"'{n}'" for n in NAMES)
_KNOWN = {kind: ", ".join(f"'{r}'" for r in sorted(names)) for kind, names in (("property", relations.PROPERTIES), ("multi", relations.MULTI_VALUED), ("single", relations.SINGLE_VALUED))}
REL_SQL = f"""{TURNS_SQL}, t AS (SELECT turn_id, us, trim(regexp_replace(lower(trim([{_LIST}][k % 6 + 1])), '[^a-z0-9]+', '_', 'g'), '_') AS relation FROM turns),
c AS (SELECT *, CASE WHEN relation IN ({_KNOWN['property']}) THEN 'property' WHEN relation IN ({_KNOWN['multi']}) THEN 'multi' WHEN relation IN ({_KNOWN['single']}) THEN 'single' END AS kind FROM t)"""


def _named(spark, sf_dir):
    return turns(spark, sf_dir).select("turn_id", "us", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("k") % 6 + 1).cast("int")).alias("relation"))


@add(f"WITH {REL_SQL} SELECT turn_id, relation, kind FROM c")
def relation_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir).select("turn_id", relations.normalised(F.col("relation")).alias("relation"))
    return rows.withColumn("kind", relations.cardinality(F.col("relation")))


@add(f"WITH {REL_SQL} SELECT relation, count(*) AS n, min(us) AS first_us FROM c WHERE kind IS NULL GROUP BY 1")
def relation_gap_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.relation_gaps(_named(spark, sf_dir))


ENTITY_SQL = """a AS (SELECT DISTINCT lower(trim(name)) AS name FROM (SELECT ' ' || p_name AS name FROM part UNION ALL SELECT upper(p_type) FROM part UNION ALL SELECT p_brand FROM part)),
e AS (SELECT p_partkey AS entity_id, p_name AS name, [p_type] AS aliases FROM part WHERE p_size < 10),
n AS (SELECT lower(trim(name)) AS name, entity_id, 0 AS how FROM e UNION ALL SELECT lower(trim(aliases[1])), entity_id, 1 FROM e), k AS (SELECT name, arg_min(entity_id, (how, entity_id)) AS entity_id FROM n GROUP BY 1),
f AS (SELECT a.name, k.entity_id FROM a LEFT JOIN k ON a.name = k.name)"""


def _entities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.select(F.explode(F.array(F.concat(F.lit(" "), "p_name"), F.upper("p_type"), F.col("p_brand"))).alias("name"))
    known = p.where("p_size < 10").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_type").alias("aliases"))
    return mt.get_or_create(names, known)


@add(f"WITH {ENTITY_SQL} SELECT name, coalesce(entity_id::VARCHAR, 'new-' || left(sha256(name), 16)) AS entity_id FROM f")
def entity_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)[0]


@add(f"WITH {ENTITY_SQL} SELECT name, 'new-' || left(sha256(name), 16) AS entity_id FROM f WHERE entity_id IS NULL")
def entities_to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)[1]


@add(f"""WITH {EDGES_SQL}, b AS (SELECT source AS entity, 'out' AS side, edge_id, -target AS other, strength, valid_until FROM edges UNION ALL SELECT -target, 'in', edge_id, source, strength, valid_until FROM edges),
r AS (SELECT *, valid_until IS NOT NULL AS expired, row_number() OVER (PARTITION BY entity, side ORDER BY valid_until IS NOT NULL, strength DESC, edge_id)::INT AS rank FROM b) SELECT entity, side, rank, edge_id, other, expired FROM r""")
def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges on both sides of customers and parts (negative ids), ranked, with ended edges behind the live ones."""
    return mt.entity_view(edges(spark, sf_dir).withColumn("target", -F.col("target")), most=None, with_expired=True)


SLOT_SQL = f"""{TURNS_SQL}, s AS (SELECT ['global', 'project', 'conversation'][k % 3 + 1] AS tier, conversation_id % 20 AS owner, topic AS name, 'v' || turn_id AS text, turn_id AS version FROM turns),
n AS (SELECT *, row_number() OVER (PARTITION BY tier, owner, name ORDER BY version DESC) AS nth FROM s), l AS (SELECT tier, owner, name, text, version FROM n WHERE nth = 1)"""


def _slots(spark, sf_dir):
    tier = F.element_at(F.array(F.lit("global"), F.lit("project"), F.lit("conversation")), (F.col("k") % 3 + 1).cast("int"))
    return turns(spark, sf_dir).select(tier.alias("tier"), (F.col("conversation_id") % 20).alias("owner"), F.col("topic").alias("name"), F.concat(F.lit("v"), "turn_id").alias("text"), F.col("turn_id").alias("version"))


@add(f"WITH {SLOT_SQL} SELECT * FROM l")
def slots_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.latest_slots(_slots(spark, sf_dir))


@add(f"""WITH {TURNS_SQL}, w AS (SELECT turn_id, CASE WHEN k % 11 = 0 THEN 'team' ELSE 'global' END AS tier, CASE WHEN k % 7 = 0 THEN 'Bad Name' ELSE topic END AS name, repeat('x', k * 20) AS text, CASE WHEN k % 2 = 0 THEN k END AS version FROM turns),
e AS (SELECT *, CASE WHEN tier NOT IN ('global', 'project', 'conversation') THEN 'unknown tier' WHEN NOT regexp_full_match(name, '[a-z0-9_-]{{1,64}}') THEN 'bad name' WHEN length(text) // 4 > 300 THEN 'too long' END AS error FROM w)
SELECT turn_id, CASE WHEN error IS NULL THEN coalesce(version, 0) + 1 END::INT AS version, error FROM e""")
def slot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    made = mt.write_slot(F.when(k % 11 == 0, "team").otherwise("global"), F.when(k % 7 == 0, "Bad Name").otherwise(F.col("topic")), F.repeat(F.lit("x"), k * 20), F.when(k % 2 == 0, k))
    return turns(spark, sf_dir).select("turn_id", made.alias("m")).select("turn_id", "m.*")


@add(f"""WITH {SLOT_SQL}, g AS (SELECT owner, string_agg(text, chr(10) ORDER BY name, text) AS slots FROM l WHERE tier = 'global' GROUP BY 1),
u AS (SELECT conversation_id % 25 AS owner, arg_max('s' || k, (us, turn_id)) AS summary FROM turns GROUP BY 1) SELECT coalesce(g.owner, u.owner) AS owner, slots, summary FROM g FULL JOIN u ON g.owner = u.owner""")
def session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = turns(spark, sf_dir).select((F.col("conversation_id") % 25).alias("owner"), F.concat(F.lit("s"), "k").alias("summary"), "us", F.col("turn_id").alias("session"))
    return mt.session_start(mt.latest_slots(_slots(spark, sf_dir)), sessions)


@add("""WITH e AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' ELSE 'rejected' END AS state, CASE user_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' END AS verdict FROM events)
SELECT id, CASE WHEN state = 'pending' AND verdict = 'approve' THEN 'active' WHEN state = 'pending' AND verdict = 'reject' THEN 'rejected' ELSE state END AS state FROM e""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(e.alias("id"), F.when(e % 3 == 0, "pending").when(e % 3 == 1, "active").otherwise("rejected").alias("state"), F.when(u % 3 == 0, "approve").when(u % 3 == 1, "reject").alias("verdict"))
    return mt.review(rows, F.col("verdict"))


@add("SELECT doc_id FROM documents WHERE (doc_id % 5 = 0 OR length(text) > 4200) AND doc_id NOT IN (SELECT page_id FROM pages WHERE page_id % 2 = 0) ORDER BY doc_id % 1000 DESC, doc_id LIMIT 50")
def chunk_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest documents that no chunk belongs to; a bounded share of work is the feature."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 5 == 0).alias("is_document"), (F.col("doc_id") % 1000).alias("us"))
    return mt.backlog(d, read(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("doc_id")))


@add(f"""WITH {EDGES_SQL}, g AS (SELECT * FROM edges WHERE batch % 3 = 0), l AS (SELECT * FROM edges WHERE batch % 3 > 0),
x AS (SELECT source AS entity FROM g UNION SELECT target FROM g), y AS (SELECT source AS entity FROM l UNION SELECT target FROM l)
SELECT 'edge' AS kind, edge_id AS id FROM g UNION ALL SELECT 'entity', entity FROM x WHERE entity NOT IN (SELECT entity FROM y)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of deleted batches, and the entities that lose their last edge."""
    e = edges(spark, sf_dir)
    gone, orphans = mt.cascade(e.where("batch % 3 = 0").select("batch").distinct(), e)
    return gone.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).unionByName(orphans.select(F.lit("entity").alias("kind"), F.col("entity").alias("id")))


@add("SELECT p_partkey FROM part WHERE p_size % 3 > 0 OR p_brand = 'Brand#2'")
def derived_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3 == 0).alias("is_derived"), F.col("p_brand").alias("project"))
    return mt.derived_visible(rows, F.lit("Brand#2")).select("p_partkey")


@add(f"WITH {TURNS_SQL}, m AS (SELECT DISTINCT event_id FROM events WHERE event_type = 'error' AND user_id % 4 = 0) SELECT turn_id, turn_id IN (SELECT event_id FROM m) AS is_meta FROM turns")
def meta_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "events").select(F.col("event_id").alias("turn_id"), F.when((F.col("event_type") == "error") & (F.col("user_id") % 4 == 0), "Meta").otherwise("Other").alias("tag"))
    return mt.meta_turns(turns(spark, sf_dir), tags)


@add("""WITH a AS (SELECT event_id AS id, lower(trim(CASE event_id % 4 WHEN 0 THEN ' Keep' WHEN 1 THEN 'MERGE ' WHEN 2 THEN 'perhaps' END)) AS v FROM events)
SELECT id, CASE WHEN v IN ('keep', 'merge', 'expire') THEN v ELSE 'dismissed' END AS verdict, CASE WHEN v IN ('keep', 'merge', 'expire') THEN NULL ELSE 'unknown verdict' END AS why FROM a""")
def agent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 4
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(e == 0, " Keep").when(e == 1, "MERGE ").when(e == 2, "perhaps").alias("answer"))
    return mt.bounded_verdicts(rows, ("keep", "merge", "expire"))


@add("""WITH s AS (SELECT doc_id, CASE WHEN length(text) <= 2400 THEN text ELSE left(text, 800) || chr(10) || '[…]' || chr(10) || substr(text, floor(length(text) / 2 - 400)::INT + 1, 800) || chr(10) || '[…]' || chr(10) || right(text, 800) END AS t FROM documents)
SELECT doc_id AS id, CASE WHEN contains(t, 'user:') OR contains(t, '@') THEN 'transcript' ELSE 'document' END AS kind FROM s""")
def blob_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the model: an answer only where the sample holds a speaker or an address."""
    sample = mt.sample_of(F.col("text"))
    answer = F.when(F.contains(sample, F.lit("user:")) | F.contains(sample, F.lit("@")), "Transcript ")
    return mt.classified(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), answer, ("document", "transcript"))


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id, round(list_dot_product(qe, e), 6) AS score FROM q, v WHERE vec_id % 100 > 0), b AS (SELECT query_id, arg_max(vec_id, (score, -vec_id)) AS p, max(score) AS best FROM s GROUP BY 1)
SELECT query_id AS id, CASE WHEN best >= 0.3 THEN 'reinforce' ELSE 'insert' END AS action, CASE WHEN best >= 0.3 THEN p END AS pattern_id FROM b""")
def pattern_reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a new pattern, the others as known ones."""
    from engram.functions import vectors

    v, q = _vectors(spark, sf_dir)
    near = vectors.block_topk(v.where("vec_id % 100 > 0"), q, 1, "vec_id", "embedding").select(F.col("query_id").alias("id"), F.col("id").alias("pattern_id"), "score")
    return mt.reinforced(q.select(F.col("query_id").alias("id")), near, 0.3)


@add(f"""WITH {TURNS_SQL}, j AS (SELECT n_nationkey AS job, (n_nationkey % 5 + 1) * {DAY_US // 4} AS every FROM nation), r AS (SELECT conversation_id % 40 AS job, max(us) AS last FROM turns WHERE k < 50 GROUP BY 1),
d AS (SELECT j.job, CASE WHEN last IS NULL THEN 1 ELSE least(96, floor(({NOW_US} - last) / every)) END::INT AS cycles FROM j LEFT JOIN r ON j.job = r.job) SELECT * FROM d WHERE cycles >= 1""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job"), ((F.col("n_nationkey") % 5 + 1) * F.lit(DAY_US // 4)).alias("interval_us"))
    runs = turns(spark, sf_dir).where("k < 50").select((F.col("conversation_id") % 40).cast("int").alias("job"), "us")
    return mt.due_jobs(jobs, runs, NOW_US)


@add(f"""WITH {TURNS_SQL}, t AS (SELECT conversation_id AS task, turn_id AS worker, us, CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'leased' ELSE 'done' END AS state, us - {DAY_US} AS leased FROM turns)
SELECT task, arg_min(worker, (us, worker)) AS worker FROM t WHERE state = 'open' OR (state = 'leased' AND leased + {DAY_US} * 2 < {NOW_US}) GROUP BY 1""")
def lease_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 3
    rows = turns(spark, sf_dir).select(
        F.col("conversation_id").alias("task"), F.col("turn_id").alias("worker"), F.col("us").alias("asked_us"), F.when(k == 0, "open").when(k == 1, "leased").otherwise("done").alias("state"), (F.col("us") - DAY_US).alias("leased_us")
    )
    return mt.claims(rows, NOW_US, 2 * DAY_US)


CHOSEN = "SELECT 'turn' AS kind, turn_id AS id FROM turns WHERE k % 25 = 0 UNION ALL SELECT 'entity', c_custkey FROM customer WHERE c_acctbal < 0"


@add(f"""WITH {TURNS_SQL}, {EDGES_SQL}, c AS ({CHOSEN}) SELECT 'turn' AS kind, id FROM c WHERE kind = 'turn'
UNION ALL SELECT 'edge', edge_id FROM edges WHERE valid_until IS NULL AND (source IN (SELECT id FROM c WHERE kind = 'entity') OR target IN (SELECT id FROM c WHERE kind = 'entity'))""")
def forget_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    chosen = t.where("k % 25 = 0").select(F.lit("turn").alias("kind"), F.col("turn_id").alias("id")).unionByName(read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.lit("entity").alias("kind"), F.col("c_custkey").alias("id")))
    hidden, expired = mt.forgotten(t, edges(spark, sf_dir), chosen, NOW_US)
    return hidden.select(F.lit("turn").alias("kind"), F.col("turn_id").alias("id")).unionByName(expired.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


@add(f"""WITH {TURNS_SQL}, m AS (SELECT turn_id, CASE WHEN turn_id % 14 = 0 THEN NULL ELSE turn_id % 5 END AS cluster_id FROM turns WHERE turn_id % 7 = 0)
SELECT t.turn_id, CASE WHEN m.turn_id IS NOT NULL THEN m.cluster_id ELSE t.cluster_id END::BIGINT AS cluster_id, m.turn_id IS NOT NULL AS is_manual FROM turns t LEFT JOIN m ON t.turn_id = m.turn_id""")
def manual_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    manual = t.where("turn_id % 7 = 0").select("turn_id", F.when(F.col("turn_id") % 14 > 0, F.col("turn_id") % 5).alias("cluster_id"))
    return mt.overridden(t, manual, "turn_id", "cluster_id")


@add(f"""WITH {TURNS_SQL}, d AS (SELECT conversation_id, max(us) AS last FROM turns WHERE topic = 'view' GROUP BY 1), r AS (SELECT conversation_id, max(us) AS us FROM turns WHERE topic = 'error' GROUP BY 1)
SELECT r.conversation_id, {NOW_US} - us AS age_us FROM r LEFT JOIN d ON r.conversation_id = d.conversation_id WHERE (last IS NULL OR last < us) AND {NOW_US} - us > {DAY_US}""")
def stale_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last error is a day old and was never looked at since."""
    t = turns(spark, sf_dir)
    return mt.stale(t.where("topic = 'error'").groupBy("conversation_id").agg(F.max("us").alias("us")), t.where("topic = 'view'").select("conversation_id", "us"), "conversation_id", NOW_US, DAY_US)


@add(f"""WITH {TURNS_SQL}, b AS (SELECT conversation_id AS entity, turn_id, us, topic AS text, lag(topic) OVER (PARTITION BY conversation_id ORDER BY us, turn_id) AS before FROM turns), c AS (SELECT * FROM b WHERE before IS NULL OR text <> before),
p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us, turn_id)::INT AS version, count(*) OVER (PARTITION BY entity) AS n FROM c) SELECT entity, version, text, version = n AS is_current FROM p WHERE version > n - 5""")
def description_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.col("conversation_id").alias("entity"), F.col("turn_id").alias("edit"), "us", F.col("topic").alias("text"))
    return mt.journal(rows)


@add("""WITH s AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, name, us FROM (SELECT p_type || ' ' || p_brand AS name, p_partkey AS us FROM part))
SELECT slug, arg_max(name, (us, name)) AS name, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM s WHERE slug <> '' GROUP BY 1""")
def project_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.registry(read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"), F.col("p_partkey").alias("us")))


@add("""WITH s AS (SELECT DISTINCT replace(p_brand, '#', '') AS module, replace(p_brand, '#', '') || '.' || p_type AS symbol, p_type AS line FROM part UNION SELECT DISTINCT replace(p_brand, '#', ''), replace(p_brand, '#', '') || '.' || p_type || '.f' || p_size, '  f' || p_size FROM part)
SELECT module, string_agg(line, chr(10) ORDER BY symbol) AS outline FROM s GROUP BY 1""")
def architecture_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    module = F.replace("p_brand", F.lit("#"), F.lit(""))
    names = F.array(module, F.concat_ws(".", module, "p_type"), F.concat(module, F.lit("."), "p_type", F.lit(".f"), F.col("p_size").cast("string")))
    return mt.outline(p.select(module.alias("module"), F.explode(names).alias("symbol")))
