"""Queries of audits and of the evaluation's remaining reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import audit as au
from engram.plans.base import Plans
from engram.plans.evaluate import SCORES_SQL, _scores
from engram.sources.driver import TURNS_SQL, read, turns

PLANS = Plans()
add = PLANS.add


@add(f"WITH {SCORES_SQL} SELECT probe, condition FROM scores WHERE CASE WHEN failed THEN 'Zero_Shot' ELSE 'Needs_Memory' END = 'Zero_Shot' AND score < 3")
def gating_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.gating_failures(_scores(spark, sf_dir).withColumn("label", F.when(F.col("failed"), "Zero_Shot").otherwise("Needs_Memory"))).select("probe", "condition")


@add(f"""WITH {SCORES_SQL}, m(category, condition) AS (VALUES ('early', 1), ('early', 2), ('late', 6), ('late', 7), ('all', 1), ('all', 4), ('all', 7))
SELECT category, condition, round(avg(score), 6) AS mean, count(*) AS n FROM scores JOIN m USING (condition) GROUP BY 1, 2""")
def category_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("early", 1), ("early", 2), ("late", 6), ("late", 7), ("all", 1), ("all", 4), ("all", 7)]
    return au.category_averages(_scores(spark, sf_dir), spark.createDataFrame(rows, "category string, condition int"))


@add("""WITH e AS (SELECT (event_id * 37 % 100) / 100.0::DOUBLE * 0.6 + (user_id % 3 = 0)::INT * 0.3::DOUBLE AS chance, user_id % 3 = 0 AS target FROM events), t AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7])::DOUBLE AS threshold),
s AS (SELECT threshold, round(count(*) FILTER (target AND chance >= threshold) / count(*) FILTER (target), 6) AS recall, round(count(*) FILTER (NOT target AND chance < threshold) / count(*) FILTER (NOT target), 6) AS specificity FROM e, t GROUP BY 1)
SELECT * FROM s WHERE recall >= 0.8 ORDER BY specificity DESC, threshold LIMIT 1""")
def decision_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("user_id") % 3 == 0
    rows = read(spark, sf_dir, "events").select((F.col("event_id") * 37 % 100 / 100 * F.lit(0.6) + hit.cast("int") * F.lit(0.3)).alias("chance"), hit.alias("target"))
    return au.tuned(rows, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7], 0.8)


@add("""WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'use that again' ELSE 'a new thing' END AS text, CASE WHEN user_id % 3 > 0 THEN 'c' || user_id END AS context, user_id % 5 = 0 AS needs FROM events),
h AS (SELECT * FROM e WHERE NOT needs AND context IS NOT NULL AND contains(text, 'that')) SELECT * FROM h UNION ALL SELECT id, text, NULL, needs FROM h""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.functions import text as tx

    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "use that again").otherwise("a new thing").alias("text"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("c"), "user_id")).alias("context"), (F.col("user_id") % 5 == 0).alias("needs")
    )
    return au.hard_negatives(rows, tx.contains_word(F.col("text"), tx.REFERENTIAL_WORDS))


@add("""WITH s AS (SELECT event_id, list_distinct(['L' || user_id % 4, 'L' || event_id % 6]) AS labels FROM events), f AS (SELECT * FROM s WHERE list_contains(labels, 'L1')), c AS (SELECT unnest(list_filter(labels, lambda l: l <> 'L1')) AS companion FROM f)
SELECT companion, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS share FROM c GROUP BY 1""")
def label_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.array_distinct(F.array(F.concat(F.lit("L"), F.col("user_id") % 4), F.concat(F.lit("L"), F.col("event_id") % 6))).alias("labels"))
    return au.firing(rows, "L1")


@add("""WITH m AS (SELECT s_suppkey AS model, s_suppkey % 40 AS n, CASE WHEN s_suppkey % 6 > 0 THEN s_acctbal END AS loss, 4000.0::DOUBLE AS old FROM supplier)
SELECT model, n >= 20 AND coalesce(loss <= old, false) AS promote, CASE WHEN n < 20 THEN 'too few labels' WHEN NOT coalesce(loss <= old, false) THEN 'loss is worse' ELSE 'promoted' END AS why FROM m""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return au.promotion(read(spark, sf_dir, "supplier").select(s.alias("model"), (s % 40).alias("n_labels"), F.when(s % 6 > 0, F.col("s_acctbal")).alias("loss"), F.lit(4000.0).alias("old_loss")))


@add(f"""WITH {TURNS_SQL}, c AS (SELECT conversation_id, count(*) AS total FROM turns GROUP BY 1), n AS (SELECT *, greatest(1, total // 8)::INT AS n FROM c), p AS (SELECT conversation_id, total, n, total / n AS step, i AS nth FROM n, range(1, 100000) r(i) WHERE i <= n),
u AS (SELECT *, ('0x' || left(md5(conversation_id || ':' || nth), 6))::BIGINT / 16777215.0::DOUBLE AS unit FROM p),
a AS (SELECT *, CASE WHEN nth = n THEN total ELSE least(greatest(round(step * nth + (unit * 2 - 1) * 0.2::DOUBLE * step)::BIGINT, 1), total - 3) END AS at_ FROM u),
l AS (SELECT *, lead(at_) OVER (PARTITION BY conversation_id ORDER BY nth) AS next_ FROM a) SELECT conversation_id, at_ AS "at" FROM l WHERE (next_ IS NULL OR next_ - at_ >= 3) AND at_ >= 1""")
def checkpoint_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = turns(spark, sf_dir).groupBy("conversation_id").agg(F.count("*").alias("total"))
    return au.checkpoints(sizes, every=8, gap=3)


@add(f"""WITH {SCORES_SQL}, p AS (SELECT probe, avg(score) FILTER (condition = 1) AS a, avg(score) FILTER (condition = 2) AS b FROM scores GROUP BY 1), q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
u AS (SELECT r AS round_, a, b, ('0x' || left(md5(r || ':' || probe), 6))::BIGINT / 16777216.0::DOUBLE AS unit FROM q, range(1, 201) t(r)),
d AS (SELECT *, CASE WHEN unit < 0.36787944 THEN 0 WHEN unit < 0.73575888 THEN 1 WHEN unit < 0.9196986 THEN 2 ELSE 3 END AS times, CASE WHEN b > a THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END::DOUBLE AS won FROM u),
e AS (SELECT round_, sum(times * (b - a)) / sum(times) AS delta, sum(times * won) / sum(times) AS win FROM d GROUP BY 1)
SELECT (SELECT round(avg(b - a), 6) FROM q) AS delta, (SELECT round(avg(CASE WHEN b > a THEN 1.0 WHEN b = a THEN 0.5 ELSE 0.0 END), 6) FROM q) AS win, round(quantile_cont(delta, 0.025), 6) AS delta_low, round(quantile_cont(delta, 0.975), 6) AS delta_high,
round(quantile_cont(win, 0.025), 6) AS win_low, round(quantile_cont(win, 0.975), 6) AS win_high FROM e""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition 2 over condition 1 on the probes that have both."""
    s = _scores(spark, sf_dir)
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("score")))
    pairs = s.groupBy("probe").agg(mean(1).alias("a"), mean(2).alias("b")).where("a is not null and b is not null")
    return au.paired_bootstrap(pairs)


@add(f"""WITH {TURNS_SQL}, q AS (SELECT conversation_id, floor(value * 30)::BIGINT AS tokens, ntile(4) OVER (PARTITION BY conversation_id ORDER BY us, turn_id)::INT AS quartile FROM turns) SELECT conversation_id, quartile, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM q GROUP BY 1, 2""")
def quartile_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.quartile_chunks(turns(spark, sf_dir).withColumn("tokens", F.floor(F.col("value") * 30)))


@add(f"""WITH {SCORES_SQL}, b AS (SELECT avg(tokens) AS bt, avg(fragments) AS bf FROM scores WHERE condition = 1), m AS (SELECT condition, avg(tokens) AS t, avg(fragments) AS f FROM scores GROUP BY 1)
SELECT condition, round(t, 6) AS tokens, round(f, 6) AS fragments, round(1 - t / bt, 6) AS token_savings, round(1 - f / bf, 6) AS fragment_savings FROM m, b""")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.savings(_scores(spark, sf_dir).withColumn("is_base", F.col("condition") == 1))


@add("""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS low FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(low, 'small') OR contains(low, 'economy') THEN 'cheap' END, CASE WHEN contains(low, 'ring') THEN 'round' END], lambda x: x IS NOT NULL), ',') AS labels FROM p""")
def weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = au.weak_labels(F.concat_ws(" ", "p_name", "p_type"), {"cheap": ("small", "economy"), "round": ("ring",)})
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(made, ",").alias("labels"))
