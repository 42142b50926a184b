"""Evaluation queries: lines as probe scores, labels as truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import evaluate as ev
from engram.plans.base import Plans
from engram.sources.driver import TURNS_SQL, read, turns

PLANS = Plans()
add = PLANS.add

SCORES_SQL = """scores AS (SELECT l_orderkey AS probe, l_linenumber AS condition, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber // 2 ELSE (l_linenumber - 1) // 2 END AS pair,
CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 5 + 1)::DOUBLE END AS score, l_suppkey % 9 = 0 AS failed, l_extendedprice / 10 + 1 AS tokens, l_quantity AS fragments, l_returnflag AS leg FROM lineitem)"""


def _scores(spark, sf_dir):
    n = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("probe"), n.alias("condition"), F.when(n % 2 == 1, F.floor(n / 2)).otherwise(F.floor((n - 1) / 2)).cast("int").alias("pair"),
        F.when(F.col("l_partkey") % 4 > 0, (F.col("l_partkey") % 5 + 1).cast("double")).alias("score"), (F.col("l_suppkey") % 9 == 0).alias("failed"),
        (F.col("l_extendedprice") / 10 + 1).alias("tokens"), F.col("l_quantity").alias("fragments"), F.col("l_returnflag").alias("leg"),
    )


@add("""WITH s AS (SELECT event_id // 5 AS probe, (event_id % 5)::INT AS condition, ((event_id % 5) // 2)::INT AS pair, CASE WHEN user_id % 4 > 0 THEN (user_id % 5 + 1)::DOUBLE END AS score, user_id % 9 = 0 AS failed FROM events),
w AS (SELECT *, first_value(score IGNORE NULLS) OVER (PARTITION BY probe, pair ORDER BY condition ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS paired, round_even(avg(score) OVER (PARTITION BY probe), 0) AS mean FROM s)
SELECT probe, condition, coalesce(score, CASE WHEN failed THEN 1.0 END, paired, mean, 3.0)::DOUBLE AS value,
CASE WHEN score IS NOT NULL THEN 'observed' WHEN failed THEN 'failed' WHEN paired IS NOT NULL THEN 'paired' WHEN mean IS NOT NULL THEN 'probe' ELSE 'default' END AS kind FROM w""")
def score_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, sf_dir, "events").select(
        F.floor(e / 5).alias("probe"), (e % 5).cast("int").alias("condition"), F.floor(e % 5 / 2).cast("int").alias("pair"),
        F.when(u % 4 > 0, (u % 5 + 1).cast("double")).alias("score"), (u % 9 == 0).alias("failed"),
    )
    return ev.impute(rows)


@add(f"""WITH {SCORES_SQL} SELECT condition, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(avg(tokens), 6) AS tokens, round(avg(score / (tokens / 1000)), 6) AS tur,
round(avg(score / fragments), 6) AS spf, round(100 * count(*) FILTER (score >= 4) / count(*), 4) AS good, round(100 * count(*) FILTER (score >= 3 AND score < 4) / count(*), 4) AS ok,
round(100 * count(*) FILTER (score < 3) / count(*), 4) AS poor FROM scores WHERE score IS NOT NULL GROUP BY 1""")
def condition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summarise(_scores(spark, sf_dir).where("score is not null"))


@add(f"""WITH {SCORES_SQL}, f AS (SELECT probe, arg_min(leg, (-tokens, condition)) AS leg FROM scores GROUP BY 1), a AS (SELECT DISTINCT probe, leg FROM scores)
SELECT a.leg AS condition, count(*) FILTER (f.leg = a.leg) AS wins, count(*) AS appearances, round(count(*) FILTER (f.leg = a.leg) / count(*), 6) AS rate FROM a JOIN f USING (probe) WHERE a.leg IN ('A', 'N', 'R') GROUP BY 1""")
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of a probe: its flags by tokens."""
    s = _scores(spark, sf_dir)
    order = F.array_sort(F.collect_list(F.struct((-F.col("tokens")).alias("t"), "condition", "leg")))
    rankings = s.groupBy("probe").agg(F.array_distinct(F.transform(order, lambda x: x["leg"])).alias("ranking"))
    return ev.wins(rankings, ["A", "N", "R"])


@add("SELECT floor(l_partkey / 50)::BIGINT * 50 AS bin, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def longitudinal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("score"))
    return ev.binned(rows, F.col("l_partkey"))


@add(f"WITH {SCORES_SQL} SELECT condition, count(*) AS n, round(corr(fragments, tokens), 3) AS r FROM scores GROUP BY 1 HAVING count(*) >= 3")
def fragment_score_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("n"), F.round(F.corr("fragments", "tokens"), 3).alias("r")).where("n >= 3")


@add(f"""WITH {SCORES_SQL}, m AS (SELECT leg, avg(n) AS mean FROM (SELECT probe, leg, count(*) AS n FROM scores GROUP BY ALL) GROUP BY 1) SELECT leg, round(mean, 6) AS mean, round(mean / sum(mean) OVER (), 6) AS share FROM m""")
def leg_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.leg_shares(_scores(spark, sf_dir))


LABEL_SETS = """sets AS (SELECT event_id, list_distinct(['L' || user_id % 4, 'L' || user_id % 6]) AS a, list_distinct(['L' || event_id % 5, 'L' || user_id % 6]) AS b, ['L' || event_id % 4] AS c FROM events)"""


def _sets(spark, sf_dir):
    name = lambda c, n: F.concat(F.lit("L"), F.col(c) % n)
    e = read(spark, sf_dir, "events")
    one = lambda *x: e.select("event_id", F.array_distinct(F.array(*x)).alias("labels"))
    return one(name("user_id", 4), name("user_id", 6)), one(name("event_id", 5), name("user_id", 6)), one(name("event_id", 4))


@add(f"WITH {LABEL_SETS} SELECT event_id, len(list_intersect(a, b)) > 0 AS overlap, list_sort(a) = list_sort(b) AS exact FROM sets")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _sets(spark, sf_dir)
    return ev.agreement(a, b, "event_id")


@add(f"""WITH {LABEL_SETS}, x AS (SELECT event_id, list_intersect(a, list_filter(b, lambda l: l <> 'L' || event_id % 2)) AS both_, a, list_filter(b, lambda l: l <> 'L' || event_id % 2) AS b, c FROM sets),
y AS (SELECT *, list_distinct(list_concat(list_intersect(a, c), list_intersect(b, c))) AS third FROM x)
SELECT event_id, array_to_string(list_sort(CASE WHEN len(both_) > 0 THEN both_ WHEN len(third) > 0 THEN third ELSE [] END), ',') AS labels,
CASE WHEN len(both_) > 0 THEN 'agreed' WHEN len(third) > 0 THEN 'majority' ELSE 'human' END AS how FROM y""")
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _sets(spark, sf_dir)
    drop = F.concat(F.lit("L"), F.col("event_id") % 2)
    return ev.merge_labels(a, b.withColumn("labels", F.array_remove("labels", drop)), c, "event_id")


PROBS = """rows_ AS (SELECT 'quality' AS label, quality = 1 AS target, (doc_id * 37 % 100) / 100.0::DOUBLE * 0.5 + quality * 0.4 AS chance FROM labels
UNION ALL SELECT 'toxic', toxic = 1, (doc_id * 53 % 100) / 100.0::DOUBLE * 0.5 + toxic * 0.3 FROM labels)"""


def _probs(spark, sf_dir):
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "labels")
    q = rows.select(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("target"), (d * 37 % 100 / 100 * 0.5 + F.col("quality") * 0.4).alias("chance"))
    t = rows.select(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("target"), (d * 53 % 100 / 100 * 0.5 + F.col("toxic") * 0.3).alias("chance"))
    return q.unionByName(t)


@add(f"""WITH {PROBS}, c AS (SELECT label, count(*) FILTER (target AND chance > 0.5) AS tp, count(*) FILTER (NOT target AND chance > 0.5) AS fp, count(*) FILTER (target AND NOT chance > 0.5) AS fn FROM rows_ GROUP BY 1)
SELECT label, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM c""")
def multilabel_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.f1(_probs(spark, sf_dir).withColumn("predicted", F.col("chance") > 0.5))


GRID = [round(0.05 * n, 2) for n in range(1, 20)]


@add(f"""WITH {PROBS}, g AS (SELECT unnest({GRID})::DOUBLE AS threshold), s AS (SELECT label, threshold, count(*) FILTER (target AND chance > threshold) AS tp, count(*) FILTER (target <> (chance > threshold)) AS wrong FROM rows_, g GROUP BY ALL),
f AS (SELECT label, threshold, round(coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0), 6) AS f1 FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS nth FROM f) SELECT label, threshold, f1 FROM r WHERE nth = 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sweep(_probs(spark, sf_dir), GRID)


@add("""WITH c AS (SELECT event_type || user_id % 13 AS label, count(*) AS n FROM events GROUP BY 1) SELECT label, n, CASE WHEN n < 150 THEN 'DROP' WHEN n < 300 THEN 'thin' ELSE 'ok' END AS verdict FROM c""")
def label_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.floors(read(spark, sf_dir, "events").groupBy(F.concat("event_type", F.col("user_id") % 13).alias("label")).agg(F.count("*").alias("n")))


@add(f"""WITH {LABEL_SETS}, s AS (SELECT sum(len(list_intersect(a, b)))::BIGINT AS tp, sum(len(b) - len(list_intersect(a, b)))::BIGINT AS fp, sum(len(a) - len(list_intersect(a, b)))::BIGINT AS fn, count(*) FILTER (list_sort(a) = list_sort(b)) AS exact FROM sets)
SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM s""")
def micro_set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _sets(spark, sf_dir)
    return ev.set_scores(a.withColumnRenamed("labels", "gold").join(b.withColumnRenamed("labels", "predicted"), "event_id"))


@add(f"WITH {PROBS} SELECT label, round(CASE WHEN count(*) FILTER (target) = 0 THEN 1 ELSE least(10.0, count(*) FILTER (NOT target) / count(*) FILTER (target)) END, 6)::DOUBLE AS weight FROM rows_ GROUP BY 1")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.class_weights(_probs(spark, sf_dir))


@add(f"""WITH {SCORES_SQL}, m AS (SELECT condition AS nth, avg(score) AS m FROM scores WHERE score IS NOT NULL GROUP BY 1)
SELECT 'c' || nth AS condition, round(m, 6) AS mean, round(m - lag(m) OVER (ORDER BY nth), 6) AS delta, round(m - first(m) OVER (ORDER BY nth), 6) AS total FROM m""")
def step_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).where("score is not null").withColumn("nth", F.col("condition")).withColumn("condition", F.concat(F.lit("c"), "nth"))
    return ev.steps(rows)


@add(f"""WITH {TURNS_SQL}, t AS (SELECT conversation_id AS key, us AS turn, turn_id AS truth_id, topic AS answer FROM turns WHERE turn_id % 3 = 0), p AS (SELECT turn_id AS probe, conversation_id AS key, us AS turn FROM turns WHERE turn_id % 3 = 1),
j AS (SELECT probe, p.turn, answer, row_number() OVER (PARTITION BY probe ORDER BY t.turn DESC NULLS LAST, truth_id DESC) AS nth FROM p LEFT JOIN t ON t.key = p.key AND t.turn <= p.turn) SELECT probe, turn, answer FROM j WHERE nth = 1""")
def asof_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    truths = t.where("turn_id % 3 = 0").select(F.col("conversation_id").alias("key"), F.col("us").alias("turn"), F.col("turn_id").alias("truth_id"), F.col("topic").alias("answer"))
    probes = t.where("turn_id % 3 = 1").select(F.col("turn_id").alias("probe"), F.col("conversation_id").alias("key"), F.col("us").alias("turn"))
    return ev.as_of(probes, truths)


@add()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).where("score is not null").withColumn("condition", F.col("condition").cast("string"))
    return ev.bootstrap(rows)
