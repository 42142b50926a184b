"""Lifecycle and scope queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import scalars
from engram.lineage import cut
from engram.operators import deletion
from engram.operators import lifecycle as lc
from engram.operators import summaries
from engram.plans.base import Plans
from engram.sources import store
from engram.sources.driver import DAY_US, EDGES_SQL, NOW_US, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add
T0, T1 = NOW_US - 20 * DAY_US, NOW_US - 12 * DAY_US


@add(f"WITH {TURNS_SQL} SELECT turn_id, topic FROM turns WHERE conversation_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def scan_filter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("conversation_id"))
    return lc.scoped(turns(spark, sf_dir), scope).select("turn_id", "topic")


@add(f"""WITH {TURNS_SQL} SELECT turn_id FROM turns t WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = conversation_id AND c_nationkey < 5)
AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = cluster_id AND n_nationkey < 2)""")
def scope_exclusion_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("conversation_id"))
    clusters = read(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.col("n_nationkey").alias("cluster_id"))
    return lc.excluded(turns(spark, sf_dir), convs, clusters).select("turn_id")


@add(f"WITH {TURNS_SQL} SELECT turn_id FROM turns WHERE cluster_id IS NULL OR cluster_id IN (1, 4)")
def cluster_filter_or_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    links = t.where("cluster_id is not null").select("turn_id", "cluster_id")
    wanted = read(spark, sf_dir, "nation").where("n_nationkey in (1, 4)").select(F.col("n_nationkey").alias("cluster_id"))
    return lc.in_clusters_or_unlinked(t, links, wanted).select("turn_id")


@add(f"WITH {TURNS_SQL} SELECT turn_id FROM turns WHERE NOT is_private AND NOT is_archived AND decay > 0.2")
def visible_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.visible(turns(spark, sf_dir), "current", 0, 0, False).select("turn_id")


@add(f"WITH {TURNS_SQL} SELECT turn_id FROM turns WHERE us >= {T0} AND us < {T1}")
def visible_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.visible(turns(spark, sf_dir), "range", T0, T1, True).select("turn_id")


SESSION_SQL = f"""{TURNS_SQL}, g AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS new FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY us, turn_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY us, turn_id ROWS UNBOUNDED PRECEDING)::INT AS session FROM g)"""


@add(f"WITH {SESSION_SQL} SELECT turn_id, session FROM s")
def session_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.sessions(turns(spark, sf_dir), 360).select("turn_id", "session")


@add(f"WITH {SESSION_SQL} SELECT conversation_id, session, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.sessions(turns(spark, sf_dir), 360).groupBy("conversation_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@add(f"""WITH {TURNS_SQL}, h AS (SELECT *, coalesce((topic <> lag(topic) OVER w)::INT, 0) AS shift FROM turns WINDOW w AS (PARTITION BY conversation_id ORDER BY us, turn_id)),
i AS (SELECT *, sum((shift = 0)::INT) OVER (PARTITION BY conversation_id ORDER BY us, turn_id ROWS UNBOUNDED PRECEDING) AS island FROM h),
r AS (SELECT turn_id, sum(shift) OVER (PARTITION BY conversation_id, island ORDER BY us, turn_id ROWS UNBOUNDED PRECEDING)::INT AS run FROM i) SELECT turn_id, run, run >= 3 AS switch FROM r""")
def session_stickiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.stickiness(turns(spark, sf_dir))


@add(f"""WITH {TURNS_SQL}, a AS (SELECT turn_id, topic, CASE WHEN {NOW_US} - us > {7 * DAY_US} AND NOT is_bookmarked THEN decay * pow(pow(CASE WHEN topic = 'view' THEN 0.99 WHEN accesses > 0 THEN 0.98 ELSE 0.95 END::DOUBLE, 1 / 16.0::DOUBLE), 480) ELSE decay END AS d FROM turns),
f AS (SELECT turn_id, round(CASE WHEN topic = 'view' THEN greatest(d, 0.3) ELSE d END, 6) AS decay FROM a) SELECT turn_id, decay, decay < 0.1 AS is_archived FROM f""")
def turn_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.decay_turns(turns(spark, sf_dir), NOW_US, 480, F.col("topic") == "view")


@add(f"WITH {TURNS_SQL} SELECT CASE WHEN is_archived AND decay < 0.05 THEN 'cold' WHEN decay < 0.1 THEN 'archived' ELSE 'hot' END AS tier, count(*) AS n FROM turns GROUP BY 1")
def archive_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.tiers(turns(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("n"))


@add(f"""WITH {TURNS_SQL}, a AS (SELECT turn_id, topic = 'view' AS creative, greatest(0, ({NOW_US + 15 * DAY_US} - us) / 86400000000.0::DOUBLE) AS age FROM turns),
s AS (SELECT *, pow(CASE WHEN creative THEN 0.99 ELSE 0.95 END::DOUBLE, age - 30) AS raw FROM a)
SELECT turn_id, round(CASE WHEN age <= 30 THEN 1.0 WHEN creative THEN greatest(raw, 0.3) ELSE greatest(raw, 0.05) END, 6)::DOUBLE AS score,
 CASE WHEN age <= 30 THEN {NOW_US + 29 * DAY_US} END::BIGINT AS immune_until, age > 30 AND NOT creative AND greatest(raw, 0.05) < 0.1 AS is_archived FROM s""")
def import_decay_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scalars.import_decay("hybrid", F.col("us"), NOW_US + 15 * DAY_US, F.col("topic") == "view")
    return turns(spark, sf_dir).select("turn_id", made.alias("d")).select("turn_id", F.round("d.score", 6).alias("score"), "d.immune_until", "d.is_archived")


@add(f"""SELECT p_partkey AS pattern_id, NOT ({NOW_US} - ({NOW_US} - (p_partkey % 400) * {DAY_US}) > 180 * {DAY_US} AND p_size % 6 < 3) AS is_active FROM part""")
def pattern_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pattern_id"), (F.lit(NOW_US) - F.col("p_partkey") % 400 * DAY_US).alias("last_us"), (F.col("p_size") % 6).alias("reinforced"))
    return lc.stale_patterns(p, NOW_US).select("pattern_id", "is_active")


@add(f"""WITH {TURNS_SQL}, p AS (SELECT *, floor((row_number() OVER (PARTITION BY conversation_id ORDER BY us, turn_id) - 1) / 20.0)::INT AS batch FROM turns
 WHERE NOT is_private AND NOT is_document AND (decay < 0.3 OR {NOW_US} - us > {10 * DAY_US}))
SELECT conversation_id, batch, min(turn_id) AS first, max(turn_id) AS last, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 5""")
def batch_summary_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.summary_batches(turns(spark, sf_dir), NOW_US, 20, 5, 10)


@add("SELECT conv_id, count(*) AS n, sum(floor(length(text) / 4))::BIGINT AS tokens, sum(floor(length(text) / 4)) > 500 AS due FROM conversations GROUP BY 1")
def conversation_summary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.summary_gate(read(spark, sf_dir, "conversations"), 500).select("conv_id", "n", F.col("tokens").cast("long").alias("tokens"), "due")


@add("""WITH d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS m FROM d GROUP BY 1),
n AS (SELECT label, unnest(list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))) AS x, unnest(range(1, 65)) AS i FROM m) SELECT label, i::INT AS i, round(x, 6) AS x FROM n""")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lc.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return made.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@add(f"""WITH {TURNS_SQL}, m AS (SELECT cluster_id * 100 + conversation_id % 50 AS cluster_id, topic AS entity, turn_id, us FROM turns WHERE cluster_id IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY us, turn_id) AS nth FROM m), c AS (SELECT cluster_id, entity, count(DISTINCT turn_id) AS n FROM e WHERE nth <= 10 GROUP BY ALL HAVING n >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, entity)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 15""")
def recurring_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = turns(spark, sf_dir).where("cluster_id is not null").select((F.col("cluster_id") * 100 + F.col("conversation_id") % 50).alias("cluster_id"), F.col("topic").alias("entity"), "turn_id", "us")
    return lc.recurring(members)


def store_of(spark: SparkSession, sf_dir: str) -> deletion.Store:
    """Events and orders as a store: edges are stated by turns, some of them twice; patterns rest on three turns, every fourth also on another pattern."""
    t = turns(spark, sf_dir).select("turn_id", "conversation_id", F.col("turn_id").alias("batch"), "k", "cluster_id")
    # orders and lines meet once for edges, statements and entities
    e = cut(edges(spark, sf_dir).select("edge_id", "source", "target", "valid_until"))
    e = e.select("edge_id", "source", (-F.col("target")).alias("target"), ((F.col("source") * 7 + F.col("target")) % 1000).alias("batch"), "valid_until", (F.col("edge_id") % 19 == 0).alias("derived"))
    added = e.select("edge_id", "batch").unionByName(e.where("edge_id % 3 = 0").select("edge_id", ((F.col("batch") + 1) % 1000).alias("batch")))
    nodes = e.select(F.explode(F.array("source", "target")).alias("entity")).distinct()
    pattern = F.floor(F.col("turn_id") / 3).alias("pattern_id")
    evidence = t.select(pattern, F.lit("turn").alias("kind"), F.col("turn_id").alias("id"))
    evidence = evidence.unionByName(t.select(pattern).distinct().where("pattern_id % 4 = 0").select("pattern_id", F.lit("pattern").alias("kind"), (F.col("pattern_id") - 1).alias("id")))
    return deletion.Store(
        t.select("turn_id", "conversation_id", "batch"), e, added, nodes.select("entity", (F.col("entity") % 11 == 0).alias("derived"), (F.col("entity") % 13 == 0).alias("authored")),
        t.where("cluster_id is not null").select((F.col("conversation_id") * 10 + F.col("cluster_id") % 3).alias("cluster_id"), "turn_id").unionByName(t.where("k % 50 = 0").select(F.col("k").cast("long").alias("cluster_id"), "turn_id")),
        t.select(F.explode(F.array(F.col("turn_id") * 2, F.col("turn_id") * 2 + 1)).alias("chunk_id"), "turn_id"), evidence,
    )


@add(f"""WITH {TURNS_SQL}, {EDGES_SQL}, x AS (SELECT edge_id, source, -target AS target, (source * 7 + target) % 1000 AS batch, edge_id % 19 = 0 AS derived FROM edges WHERE valid_until IS NULL),
y AS (SELECT edge_id, (source * 7 + target) % 1000 AS batch FROM edges UNION ALL SELECT edge_id, (source * 7 + target) % 1000 + 1 FROM edges WHERE edge_id % 3 = 0), a AS (SELECT edge_id, batch % 1000 AS batch FROM y),
g AS (SELECT turn_id FROM turns WHERE conversation_id % 10 = 0), st AS (SELECT * FROM x WHERE NOT derived AND batch IN (FROM g)), e AS (SELECT * FROM st WHERE edge_id NOT IN (SELECT edge_id FROM a WHERE batch NOT IN (FROM g))),
lv AS (SELECT * FROM x WHERE edge_id NOT IN (SELECT edge_id FROM e)), n AS (SELECT source AS n FROM e UNION SELECT target FROM e), h AS (SELECT source AS n FROM lv UNION SELECT target FROM lv),
m AS (SELECT conversation_id * 10 + cluster_id % 3 AS c, turn_id FROM turns WHERE cluster_id IS NOT NULL UNION ALL SELECT k, turn_id FROM turns WHERE k % 50 = 0), ml AS (SELECT DISTINCT c, turn_id FROM m WHERE turn_id IN (FROM g)),
p AS (SELECT turn_id // 3 AS p, 'turn' AS kind, turn_id AS id FROM turns UNION SELECT turn_id // 3, 'pattern', turn_id // 3 - 1 FROM turns WHERE (turn_id // 3) % 4 = 0),
f1 AS (SELECT p FROM p GROUP BY p HAVING bool_and(kind = 'turn' AND id IN (FROM g))), f AS (SELECT p FROM p GROUP BY p HAVING bool_and(CASE WHEN kind = 'turn' THEN id IN (FROM g) ELSE id IN (FROM f1) END))
SELECT 'turns' AS store, count(*) AS n FROM g UNION ALL SELECT 'chunks', 2 * count(*) FROM g UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'kept_edges', (SELECT count(*) FROM st) - (SELECT count(*) FROM e)
UNION ALL SELECT 'entities', count(*) FROM n WHERE n NOT IN (FROM h) AND n % 11 <> 0 AND n % 13 <> 0 UNION ALL SELECT 'cluster_links', count(*) FROM ml
UNION ALL SELECT 'clusters', count(DISTINCT c) FROM ml WHERE c NOT IN (SELECT c FROM m WHERE turn_id NOT IN (FROM g)) UNION ALL SELECT 'patterns', count(*) FROM f
UNION ALL SELECT 'evidence', count(*) FROM p WHERE CASE WHEN kind = 'turn' THEN id IN (FROM g) ELSE id IN (FROM f) END""")
def deletion_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a tenth of the conversations, by table; the deletion uses the same frames."""
    doomed = turns(spark, sf_dir).where("conversation_id % 10 = 0").select("conversation_id")
    return deletion.manifest(deletion.plan(store_of(spark, sf_dir), doomed))


@add(f"""WITH {TURNS_SQL}, l AS (SELECT turn_id % 1500 AS doc_id, conversation_id AS conv_id, k % 3 > 0 AS enabled FROM turns WHERE turn_id % 4 = 0),
c AS (SELECT doc_id, count(DISTINCT CASE WHEN enabled THEN conv_id END) AS n, bool_or(enabled) AS any_ FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) >= 2 AS shared, CASE WHEN n IS NULL THEN 'unlinked' WHEN any_ THEN 'enabled' ELSE 'hidden' END AS status FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def document_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = turns(spark, sf_dir).where("turn_id % 4 = 0").select((F.col("turn_id") % 1500).alias("doc_id"), F.col("conversation_id").alias("conv_id"), (F.col("k") % 3 > 0).alias("enabled"))
    return lc.document_visibility(read(spark, sf_dir, "documents").select("doc_id"), links)


@add(f"""WITH {TURNS_SQL}, m AS (SELECT conversation_id, max(us) AS us FROM turns GROUP BY 1)
SELECT conversation_id, greatest(1, least(96, floor(({NOW_US} - us) / {90 * 60_000_000}.0::DOUBLE)))::INT AS cycles FROM m""")
def missed_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns(spark, sf_dir).groupBy("conversation_id").agg(F.max("us").alias("us"))
    return m.select("conversation_id", scalars.missed_cycles(F.lit(NOW_US) - F.col("us"), 90 * 60_000_000).alias("cycles"))


@add(f"""WITH {TURNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY us DESC, turn_id DESC) AS nth, sum(k + 20) OVER (PARTITION BY conversation_id ORDER BY us DESC, turn_id DESC ROWS UNBOUNDED PRECEDING) AS used
 FROM turns WHERE NOT is_private AND NOT is_document) SELECT conversation_id, turn_id, used::BIGINT AS used FROM r WHERE used <= 400 OR nth = 1""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest turns of each conversation within a token budget; the newest always stays."""
    from pyspark.sql import Window

    order = Window.partitionBy("conversation_id").orderBy(F.desc("us"), F.desc("turn_id"))
    t = turns(spark, sf_dir).where("not is_private and not is_document")
    used = F.sum(F.col("k") + 20).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return t.withColumn("nth", F.row_number().over(order)).withColumn("used", used).where("used <= 400 or nth = 1").select("conversation_id", "turn_id", "used")


@add()
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return lc.assign_clusters(v)


@add(f"""WITH RECURSIVE {TURNS_SQL}, m AS (SELECT max(turn_id) AS top FROM turns), t AS (SELECT turn_id, CASE WHEN turn_id < top THEN top - (top - turn_id) // 3 END AS parent FROM turns, m),
d(turn_id, depth) AS (SELECT turn_id, 0::BIGINT FROM t WHERE parent IS NULL OR parent NOT IN (SELECT turn_id FROM t) UNION ALL SELECT t.turn_id, d.depth + 1 FROM t JOIN d ON t.parent = d.turn_id) SELECT turn_id, depth FROM d""")
def store_load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that answer later ones: how many rows a load must have before each."""
    t = turns(spark, sf_dir).select("turn_id")
    top = t.agg(F.max("turn_id").alias("top"))
    rows = t.join(F.broadcast(top)).select("turn_id", F.when(F.col("turn_id") < F.col("top"), F.col("top") - F.floor((F.col("top") - F.col("turn_id")) / 3)).alias("parent"))  # top is one row
    return store.load_order(rows, "turn_id", "parent")


def _digest_fold(summary: str, chunk: str) -> str:
    """A stand-in for the model: what it is given decides its answer."""
    import hashlib

    return hashlib.md5(f"{summary}\n{chunk}".encode()).hexdigest()


@add("""WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  count(*) OVER (PARTITION BY conv_id) AS most, sum(floor(length(coalesce(text, '')) / 4)) OVER (PARTITION BY conv_id) AS tokens FROM conversations),
r(c, n, summary, chunk, words, last, folded) AS (
  SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT, NULL::BIGINT, 0::BIGINT FROM t WHERE n = 1 AND tokens > 100
  UNION ALL SELECT t.c, t.n, CASE WHEN r.words + t.words >= 60 OR t.n = most THEN md5(summary || chr(10) || coalesce(chunk || chr(10) || chr(10), '') || t.text) ELSE summary END,
    CASE WHEN r.words + t.words >= 60 THEN NULL ELSE coalesce(chunk || chr(10) || chr(10), '') || t.text END, CASE WHEN r.words + t.words >= 60 THEN 0 ELSE r.words + t.words END, t.turn::BIGINT, t.n
  FROM r JOIN t ON t.c = r.c AND t.n = r.n + 1)
SELECT c AS conversation_id, summary, last AS covers_turn, folded FROM r WHERE n = (SELECT max(n) FROM t WHERE t.c = r.c)""")
def conversation_summary_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First summaries of all conversations that outgrow 100 tokens, in chunks of 60 words."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conversation_id"), F.col("turn").cast("long").alias("turn_id"), F.col("turn").cast("long").alias("us"), "text")
    none = t.limit(0).select("conversation_id", F.lit("").alias("summary"), F.col("us").alias("covers_us"), F.col("turn_id").alias("covers_turn"))
    return summaries.fold_summaries(t, none, _digest_fold, 100, 60).select("conversation_id", "summary", "covers_turn", "folded")
