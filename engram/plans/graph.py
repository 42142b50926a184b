"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import facts
from engram.operators import graph as g
from engram.plans.base import Plans
from engram.sources.driver import DAY_US, EDGES_SQL, ORDERS_NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
T0, T1 = 915_148_800_000_000, 922_924_800_000_000  # 1999-01-01 and 1999-04-01
TRUST = "coalesce(strength, 0) * coalesce(confidence, 1.0) * (1 + 0.3 * exp(-abs({now} - valid_from) / 86400000000.0::DOUBLE / 30.0::DOUBLE))"


@add(f"WITH {EDGES_SQL} SELECT edge_id, source, target FROM edges WHERE valid_from <= {T0} AND (valid_until IS NULL OR valid_until > {T0})")
def edge_validity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(g.valid_at(T0)).select("edge_id", "source", "target")


@add(f"WITH {EDGES_SQL} SELECT edge_id, round({TRUST.format(now=ORDERS_NOW_US)}, 6) AS trust FROM edges WHERE valid_until IS NULL")
def edge_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.with_trust(edges(spark, sf_dir).where(g.valid_at(None)), ORDERS_NOW_US).select("edge_id", F.round("trust", 6).alias("trust"))


@add(f"""WITH {EDGES_SQL}, a AS (SELECT c_custkey AS anchor, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS asked FROM customer),
r AS (SELECT anchor, e.*, row_number() OVER (PARTITION BY anchor ORDER BY strength DESC, edge_id)::INT AS rank FROM edges e JOIN a ON source = anchor AND relation = asked),
t AS (SELECT anchor, edge_id, {TRUST.format(now=ORDERS_NOW_US)} AS trust, rank FROM r WHERE rank <= 10) SELECT anchor, edge_id, round(trust, 6) AS trust, rank FROM t WHERE trust >= 0.5""")
def relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("anchor"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("asked"))
    return g.relation_facts(edges(spark, sf_dir), a, ORDERS_NOW_US)


# vertices of the traversal: suppliers and parts, so that both directions are used and hops stay meaningful
HOPS_SQL = f"""e AS (SELECT l_suppkey AS source, 1000000 + l_partkey AS target, l_quantity / 10 AS strength, CASE WHEN l_discount > 0 THEN 1 - l_discount END AS confidence, epoch_us(l_shipdate) AS valid_from
FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'R'),
b AS (SELECT source, target, strength, {TRUST.format(now=ORDERS_NOW_US)} AS trust FROM e), both_ AS (SELECT * FROM b UNION ALL SELECT target, source, strength, trust FROM b),
d1 AS (SELECT DISTINCT source, target FROM both_ WHERE trust >= 0.5), d2 AS (SELECT DISTINCT source, target FROM both_ WHERE strength >= 1.0),
s AS (SELECT s_suppkey AS seed, s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey % 100 = 0),
h1 AS (SELECT DISTINCT seed, d1.target AS node, 1 AS depth FROM s JOIN d1 ON s.node = d1.source),
n1 AS (SELECT * FROM h1 WHERE (seed, node) NOT IN (SELECT seed, node FROM s)),
h2 AS (SELECT DISTINCT seed, d2.target AS node, 2 AS depth FROM n1 JOIN d2 ON n1.node = d2.source),
n2 AS (SELECT * FROM h2 WHERE (seed, node) NOT IN (SELECT seed, node FROM s UNION ALL SELECT seed, node FROM n1)),
h3 AS (SELECT DISTINCT seed, d2.target AS node, 3 AS depth FROM n2 JOIN d2 ON n2.node = d2.source),
n3 AS (SELECT * FROM h3 WHERE (seed, node) NOT IN (SELECT seed, node FROM s UNION ALL SELECT seed, node FROM n1 UNION ALL SELECT seed, node FROM n2))"""


@add(f"WITH {HOPS_SQL} SELECT * FROM s UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3")
def graph_bfs_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.sources.driver import micros

    lines = read(spark, sf_dir, "lineitem").where("l_linestatus = 'O' and l_returnflag <> 'R'").select(
        F.col("l_suppkey").alias("source"), (F.col("l_partkey") + 1_000_000).alias("target"), (F.col("l_quantity") / 10).alias("strength"),
        F.when(F.col("l_discount") > 0, 1 - F.col("l_discount")).alias("confidence"), F.lit(False).alias("negated"), micros("l_shipdate").alias("valid_from"),
        F.lit(None).cast("long").alias("valid_until"),
    )
    seeds = read(spark, sf_dir, "supplier").where("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("seed"))
    return g.traverse(lines, seeds, ORDERS_NOW_US)


@add(f"""WITH {EDGES_SQL}, x AS (SELECT line, max(us) AS at_us, arg_max(event_type, (us, event_id)) AS reason FROM
 (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 + event_id % 7 AS line, epoch_us(ts) AS us, event_type, event_id FROM events WHERE event_type IN ('error', 'view')) GROUP BY 1)
SELECT edge_id, source, target, reason FROM edges JOIN x ON edge_id // 10000000 = line WHERE valid_until IS NOT NULL AND reason <> 'view'""")
def event_backed_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired edges that a journal event names; the reason "view" stands for a deleted source."""
    t = turns(spark, sf_dir).where(F.col("topic").isin("error", "view")).select((F.col("k").cast("long") * 100 + F.col("turn_id") % 7).alias("line"), "us", "topic", "turn_id")
    last = t.groupBy("line").agg(F.max_by("topic", F.struct("us", "turn_id")).alias("reason")).where("reason <> 'view'")
    return edges(spark, sf_dir).where("valid_until is not null").withColumn("line", F.floor(F.col("edge_id") / 10_000_000)).join(last, "line").select("edge_id", "source", "target", "reason")


@add(f"""WITH {EDGES_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY valid_from DESC, edge_id DESC) AS nth FROM edges
 WHERE valid_from <= {T1} AND (valid_until IS NULL OR valid_until > {T0}))
SELECT source, relation, string_agg(valid_from || ' ' || target || ' ' || CASE WHEN negated THEN '-' ELSE '+' END, '; ' ORDER BY valid_from, edge_id) AS lines, count(*) AS n FROM m WHERE nth <= 8 GROUP BY ALL""")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.entity_timeline(edges(spark, sf_dir), T0, T1)


@add(f"""WITH {EDGES_SQL} SELECT edge_id, CASE WHEN negated THEN 'retracted' ELSE 'added' END AS kind FROM edges WHERE valid_from >= {T0} AND valid_from < {T1}
UNION ALL SELECT edge_id, 'expired' FROM edges WHERE valid_until >= {T0} AND valid_until < {T1}""")
def entity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.entity_diff(edges(spark, sf_dir), T0, T1)


@add("SELECT lower(p_name) AS name, min(p_partkey) AS first, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_pairs_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.duplicate_names(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@add("""WITH RECURSIVE v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id WHERE list_dot_product(a.e, b.e) >= 0.3),
r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a), l AS (SELECT a, count(*) AS links FROM p GROUP BY 1)
SELECT v.grp::BIGINT AS "group", v.id, coalesce(l.links, 0)::BIGINT AS links, min(r.b) AS component FROM v JOIN r ON r.a = v.id LEFT JOIN l ON l.a = v.id GROUP BY ALL""")
def duplicate_pairs_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals to merge entities of one type: each entity with its number of similar ones and the class they form."""
    from engram.operators.similar import linked_groups

    rows = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return linked_groups(rows, 0.3, normalise=False)


@add(f"""WITH {EDGES_SQL} SELECT source, count(DISTINCT CASE WHEN strength < 2 THEN target END) AS n_pending, count(DISTINCT CASE WHEN strength >= 2 THEN target END) AS n_active
FROM edges WHERE valid_until IS NULL GROUP BY 1 HAVING n_pending > 3 AND n_active > 2""")
def pending_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.pile_up(edges(spark, sf_dir), F.col("strength") < 2)


COARSE = "c AS (SELECT edge_id, source % 50 AS source, target % 40 AS target, relation, negated, valid_from, valid_until FROM edges)"


def _coarse(spark, sf_dir):
    return edges(spark, sf_dir).withColumn("source", F.col("source") % 50).withColumn("target", F.col("target") % 40)


@add(f"""WITH {EDGES_SQL}, {COARSE}, p AS (SELECT source, target, relation, max(valid_from) AS yes FROM c WHERE valid_until IS NULL AND NOT negated GROUP BY ALL),
n AS (SELECT source, target, relation, max(valid_from) AS no FROM c WHERE valid_until IS NULL AND negated GROUP BY ALL)
SELECT source, target, relation, CASE WHEN yes > no THEN 'positive' ELSE 'negation' END AS winner FROM p JOIN n USING (source, target, relation)""")
def contradictions_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.contradictions(_coarse(spark, sf_dir))


@add(f"""WITH {EDGES_SQL}, {COARSE}, l AS (SELECT DISTINCT source, target, relation FROM c WHERE valid_until IS NULL AND NOT negated)
SELECT a.source, a.target, a.relation AS first, b.relation AS second FROM l a JOIN l b ON a.source = b.source AND a.target = b.target
AND (a.relation, b.relation) IN (('1-URGENT', '5-LOW'), ('2-HIGH', '4-NOT SPECIFIED'))""")
def contradictions_antonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.antonym_conflicts(_coarse(spark, sf_dir))


JOURNAL_SQL = f"""{TURNS_SQL}, j AS (SELECT turn_id AS event_id, conversation_id AS entity, topic AS relation, k % 5 AS target, us, CASE WHEN turn_id % 3 = 0 THEN 'expire' ELSE 'add' END AS kind,
CASE WHEN turn_id % 5 > 0 THEN k % 6 END AS batch FROM turns)"""


def _journal(spark, sf_dir):
    return turns(spark, sf_dir).select(
        F.col("turn_id").alias("event_id"), F.col("conversation_id").alias("entity"), F.col("topic").alias("relation"), (F.col("k") % 5).alias("target"), "us",
        F.when(F.col("turn_id") % 3 == 0, "expire").otherwise("add").alias("kind"), F.when(F.col("turn_id") % 5 > 0, F.col("k") % 6).alias("batch"),
    )


@add(f"""WITH {JOURNAL_SQL}, b AS (SELECT entity FROM j GROUP BY 1 HAVING count(*) >= 50), l AS (SELECT entity, relation, target, arg_max(kind, (us, event_id)) AS kind FROM j WHERE entity IN (SELECT entity FROM b) GROUP BY ALL)
SELECT entity, coalesce(string_agg(CASE WHEN kind = 'add' THEN relation || ':' || target END, ',' ORDER BY relation || ':' || target), '') AS facts, count(*) AS signatures FROM l GROUP BY 1""")
def journal_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.compact(_journal(spark, sf_dir), 50)


@add(f"WITH {JOURNAL_SQL} SELECT entity FROM (SELECT event_id // 2 AS entity, batch FROM j) GROUP BY 1 HAVING bool_and(batch IS NOT NULL AND batch < 5)")
def entity_deny_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _journal(spark, sf_dir).withColumn("entity", F.floor(F.col("event_id") / 2))
    return g.denied_entities(events, F.col("batch") < 5)


@add(f"""WITH {EDGES_SQL}, d AS (SELECT edge_id, round(strength * pow(pow(0.99::DOUBLE, 1 / 16.0::DOUBLE), 3000), 6) AS strength FROM edges WHERE valid_until IS NULL)
SELECT edge_id, strength, CASE WHEN strength < 0.1 THEN 'expire' WHEN strength < 0.3 THEN 'demote' ELSE 'keep' END AS action FROM d""")
def edge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.decay_edges(edges(spark, sf_dir), 3000)


@add(f"""WITH {EDGES_SQL}, r AS (SELECT source, relation, target, row_number() OVER (PARTITION BY source ORDER BY strength DESC, edge_id) AS nth FROM edges WHERE valid_until IS NULL AND NOT negated)
SELECT source, string_agg(relation || '->' || target, '|' ORDER BY nth) AS links FROM r WHERE nth <= 20 GROUP BY 1""")
def note_regeneration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.notes(edges(spark, sf_dir))


@add(f"""WITH {EDGES_SQL}, l AS (SELECT CASE WHEN source % 10 = 0 THEN source - source % 100 ELSE source END AS source, -1 - CASE WHEN target % 25 = 0 THEN target + 1 ELSE target END AS target, relation, negated, strength, confidence, valid_from FROM edges WHERE valid_until IS NULL)
SELECT source, target, relation, negated, max(strength) AS strength, max(confidence) AS confidence, min(valid_from) AS valid_from FROM l WHERE source <> target GROUP BY 1, 2, 3, 4""")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that end in 0 are merged into their hundred, and every 25th part (parts have negative ids) into the next one."""
    e = edges(spark, sf_dir).withColumn("target", -1 - F.col("target"))
    customers = e.where("source % 10 = 0").select(F.col("source").alias("old"), (F.col("source") - F.col("source") % 100).alias("new"))
    parts = e.where("(-1 - target) % 25 = 0").select(F.col("target").alias("old"), (F.col("target") - 1).alias("new"))
    return g.merge_entities(e, customers.unionByName(parts).where("old <> new").distinct())


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as triples: relations of all three kinds, a ninth of them negations."""
    names = F.array(*map(F.lit, ("knows", "uses", "status", "lives_in", "works_at")))
    return turns(spark, sf_dir).select(
        (F.col("conversation_id") % 40).alias("subject"), F.element_at(names, (F.col("k") % 5 + 1).cast("int")).alias("relation"), (F.col("turn_id") % 4).alias("target"),
        (F.col("turn_id") % 9 == 0).alias("negated"), (F.col("k") / 100).alias("confidence"), "us",
    )


# the same rule by windows over the whole log: what an event meets, where its edge begins and where it ends
EVENTS_SQL = f"""WITH {TURNS_SQL}, t AS (SELECT conversation_id % 40 AS subject, ['knows', 'uses', 'status', 'lives_in', 'works_at'][k % 5 + 1] AS relation, turn_id % 4 AS target, turn_id % 9 = 0 AS negated, k / 100 AS confidence, us, turn_id FROM turns),
l AS (SELECT *, CASE WHEN relation IN ('knows', 'uses') THEN target ELSE -1 END AS slot, row_number() OVER (ORDER BY us, target, negated, confidence, turn_id) AS pos FROM t),
d AS (SELECT *, min(CASE WHEN negated THEN pos END) OVER (PARTITION BY subject, relation, target ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS denied FROM l),
p AS (SELECT *, max(CASE WHEN NOT negated THEN pos END) OVER (PARTITION BY subject, relation, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
h AS (SELECT p.*, b.pos IS NOT NULL AND (b.denied IS NULL OR b.denied >= p.pos) AS holds, b.target AS held FROM p LEFT JOIN d b ON b.pos = p.before),
o AS (SELECT *, NOT negated AND NOT (holds AND held = target) AS opens FROM h),
e AS (SELECT *, min(CASE WHEN opens THEN pos END) OVER (PARTITION BY subject, relation, slot ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS replaced,
  CASE WHEN opens OR negated THEN pos ELSE max(CASE WHEN opens THEN pos END) OVER (PARTITION BY subject, relation, slot ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS edge,
  CASE WHEN relation = 'status' OR (opens AND holds) THEN 3.0 ELSE 1.0 END AS start FROM o),
m AS (SELECT m.*, CASE WHEN NOT m.negated THEN least(m.denied, m.replaced) WHEN m.relation = 'status' THEN m.replaced END AS ended FROM e m),
g AS (SELECT edge, count(*) - 1 AS again, max(confidence) AS confidence FROM m GROUP BY edge)"""


@add(EVENTS_SQL + """ SELECT m.subject, m.relation, m.target, m.negated, g.confidence, m.us AS valid_from, x.us AS valid_until, (CASE WHEN m.negated THEN 1 ELSE start END + again)::DOUBLE AS strength,
CASE WHEN m.negated OR start >= 3 OR again > 0 THEN 'active' ELSE 'pending' END AS state FROM m JOIN g ON m.edge = g.edge AND m.pos = m.edge LEFT JOIN l x ON x.pos = m.ended""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of all triples; a subject's log is dealt over tasks by time."""
    return facts.upsert(triples(spark, sf_dir))[0]


@add(EVENTS_SQL + """, a AS (SELECT m.*, f.before = f.edge AND o.start < 3 AS first_again FROM m LEFT JOIN m f ON f.pos = m.pos LEFT JOIN m o ON o.pos = m.edge)
SELECT subject, relation, action, count(*) AS n, max(us) AS last FROM (
  SELECT subject, relation, us, CASE WHEN negated THEN 'negated' WHEN opens THEN 'added' WHEN first_again THEN 'promoted' ELSE 'reinforced' END AS action FROM a
  UNION ALL SELECT m.subject, m.relation, x.us, 'expired' FROM m JOIN l x ON x.pos = m.ended WHERE m.pos = m.edge) GROUP BY ALL""")
def fact_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal of the upsert by subject, relation and action."""
    journal = facts.upsert(triples(spark, sf_dir))[1]
    return journal.groupBy("subject", "relation", "action").agg(F.count("*").alias("n"), F.max("us").alias("last"))


@add("""WITH b AS (SELECT lower(replace(p_brand, '#', '_')) AS module, 'C' || p_size AS cls, 'part_' || p_partkey AS fn, 'class C' || p_size || ':' || chr(10) || '    def part_' || p_partkey || '(self)' AS body FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY body) AS nth FROM b)
SELECT DISTINCT module || '.py' AS path, module AS symbol, 'module' AS kind, 1 AS line FROM b UNION ALL SELECT module || '.py', module || '.' || cls, 'class', (4 * nth - 3)::INT FROM n UNION ALL SELECT module || '.py', module || '.' || cls || '.' || fn, 'function', (4 * nth - 2)::INT FROM n""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of generated sources: a module a brand, with a class a type and a function a part."""
    body = F.concat(F.lit("class C"), "p_size", F.lit(":\n    def part_"), "p_partkey", F.lit("(self):\n        return 1\n"))
    files = read(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", "#", "_").alias("b")).agg(F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("text"))
    return g.code_symbols(files.select(F.concat(F.lower("b"), F.lit(".py")).alias("path"), "text"))


@add(f"""WITH {TURNS_SQL}, c AS (SELECT conversation_id AS entity, count(*) AS n, max(us) AS last FROM turns GROUP BY 1),
s AS (SELECT entity, n, CASE WHEN entity % 3 > 0 THEN 1 WHEN {1_706_659_200_000_000} - last > {DAY_US} AND n >= 3 THEN 2 END AS priority FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY priority, n DESC, entity)::INT AS rank FROM s WHERE priority IS NOT NULL) SELECT entity, n, priority, rank FROM r WHERE rank <= 25""")
def enrichment_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without a description by mentions, then stale ones; a top-25 report."""
    from engram.sources.driver import NOW_US

    c = turns(spark, sf_dir).groupBy(F.col("conversation_id").alias("entity")).agg(F.count("*").alias("n"), F.max("us").alias("last"))
    priority = F.when(F.col("entity") % 3 > 0, 1).when((F.lit(NOW_US) - F.col("last") > DAY_US) & (F.col("n") >= 3), 2)
    top = c.withColumn("priority", priority).where("priority is not null").orderBy("priority", F.desc("n"), "entity").limit(25)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy("priority", F.desc("n"), "entity"))).select("entity", "n", "priority", "rank")
