"""Scans of the driver's tables as the domain's tables.

Times are microseconds since 1970 as a long, taken from zone-less timestamps, so
no result depends on a session time zone.  ``NOW`` is fixed: a run is repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: 2024-01-31 00:00:00 for the event tables; 2001-08-02 for the order tables.
NOW_US = 1_706_659_200_000_000
ORDERS_NOW_US = 996_710_400_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: (turn_id, conversation_id, us, topic, k, value and the flags derived from k)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("turn_id"), F.col("user_id").alias("conversation_id"), micros("ts").alias("us"),
        F.col("event_type").alias("topic"), k.alias("k"), "value",
    ).withColumns({
        "decay": F.least(F.lit(1.0), F.col("value") / 100), "accesses": F.col("k") % 3, "is_bookmarked": F.col("k") % 10 == 0,
        "is_private": F.col("turn_id") % 17 == 0, "is_archived": F.col("value") < 5, "is_document": F.col("turn_id") % 23 == 0,
        "cluster_id": F.when(F.col("k") % 4 > 0, F.col("k") % 7),
    })


#: The same turns for oracle SQL.
TURNS_SQL = """turns AS (
  SELECT *, least(1.0, value / 100) AS decay, k % 3 AS accesses, k % 10 = 0 AS is_bookmarked, turn_id % 17 = 0 AS is_private,
         value < 5 AS is_archived, turn_id % 23 = 0 AS is_document, CASE WHEN k % 4 > 0 THEN k % 7 END AS cluster_id
  FROM (SELECT event_id AS turn_id, user_id AS conversation_id, epoch_us(ts) AS us, event_type AS topic,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as bi-temporal edges from customer to part.

    (edge_id, source, target, relation, strength, confidence, negated, valid_from, valid_until, batch)
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("valid_from"), "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", micros("l_shipdate").alias("shipped")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("edge_id"), F.col("o_custkey").alias("source"), F.col("l_partkey").alias("target"),
        F.col("o_orderpriority").alias("relation"), (F.col("l_quantity") / 10).alias("strength"),
        F.when(F.col("l_discount") > 0, 1 - F.col("l_discount")).alias("confidence"), (F.col("l_returnflag") == "R").alias("negated"),
        "valid_from", F.when(F.col("l_linestatus") == "F", F.col("shipped")).alias("valid_until"), (F.col("l_orderkey") % 97).alias("batch"),
    )


EDGES_SQL = """edges AS (
  SELECT (l_orderkey * 100 + l_linenumber) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS edge_id, o_custkey AS source, l_partkey AS target, o_orderpriority AS relation,
         l_quantity / 10 AS strength, CASE WHEN l_discount > 0 THEN 1 - l_discount END AS confidence, l_returnflag = 'R' AS negated,
         epoch_us(o_orderdate) AS valid_from, CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate) END AS valid_until,
         l_orderkey % 97 AS batch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
