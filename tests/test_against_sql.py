"""Queries against their oracle SQL on rows that once told them apart."""

import duckdb
from compare import same
from pyspark.sql import functions as F

from engram.operators import extra, joins
from engram.plans import ORACLES, QUERIES


def by_sql(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    return con


def test_html_extract_decodes_references_that_were_cut(spark, tmp_path):
    pages = [
        (1, "<title>und&amp;&amp;&amp; ver&amp</title><p>a&amp</p>b &ltc"), (2, "<title>ver&am</title><p>x&amp;lt;y &copy 2 &middot z</p>"), (3, "<h1>T &quot;q&quot; &gt</h1>text &nbsp end"),
        (4, "<title> &amp </title>"),
    ]
    by_sql(spark, tmp_path, "html_extract", pages=spark.createDataFrame(pages, "page_id long, html string"))
    got = {r.page_id: r.title for r in QUERIES["html_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: "und&&& ver&", 2: "ver&am", 3: 'T "q" >', 4: "&"}


def test_context_ledger_orders_a_block_that_is_there_twice(spark, tmp_path):
    rows = [(n, 7, 3, 1, float(q)) for n in range(40) for q in ((120, 20, 60) if n % 2 else (20, 60, 120))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    by_sql(spark, tmp_path, "context_ledger", lineitem=lines)
    got = QUERIES["context_ledger"](spark, str(tmp_path)).groupBy("request").agg(F.count_if("kept").alias("n"))
    assert {r["n"] for r in got.collect()} == {2}
    blocks = lines.select(F.col("l_orderkey").alias("request"), F.lit(1).alias("block"), F.lit(1).alias("priority"), F.col("l_quantity").alias("tokens"))
    assert extra.fit_blocks(blocks, 72).where("kept").count() == 40


def test_span_union_does_not_cross_a_line_feed(spark, tmp_path):
    made = ["alpha beta\ngamma delta epsilon zeta", "one\r\ntwo three four five six seven", "x y z w v u t s r q p o n m", "word.\n", "a\n\nb c d e f g"]
    docs = [(1000 * n + at, text) for n, text in enumerate(made) for at in range(40)]
    by_sql(spark, tmp_path, "span_union", documents=spark.createDataFrame(docs, "doc_id long, text string"))
    texts, spans = spark.createDataFrame([(1, made[0])], "id long, text string"), spark.createDataFrame([(1, 11, 13, "A", 0.5)], "id long, start int, stop int, label string, score double")
    assert [(r.start, r.stop, r.text) for r in joins.united_spans(texts, spans).collect()] == [(11, 16, "gamma")]


def test_entity_view_shows_every_edge(spark, tmp_path):
    lines = [(n, 5, 1, 1, float(n % 7), 0.1 if n % 2 else 0.0, "N", "F" if n % 3 else "O", "2001-01-01 00:00:00") for n in range(60)]
    line = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string")
    orders = spark.createDataFrame([(n, 9, "2000-01-01 00:00:00", "1-URGENT") for n in range(60)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string")
    ntz = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    by_sql(spark, tmp_path, "entity_view", lineitem=ntz(line, "l_shipdate"), orders=ntz(orders, "o_orderdate"))
    got = QUERIES["entity_view"](spark, str(tmp_path)).groupBy("entity", "side").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert {(r.entity, r.side, r.n, r["last"]) for r in got} == {(9, "out", 60, 60), (-5, "in", 60, 60)}
