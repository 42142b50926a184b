"""Queries of the way from legs to a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import assemble as asm
from engram.operators import retrieve as rt
from engram.plans.base import Plans
from engram.plans.retrieve import RRF_SQL, V_SQL, WS, legs_by_text, prompts
from engram.sources.driver import EDGES_SQL, TURNS_SQL, edges, read, turns

PLANS = Plans()
add = PLANS.add


@add(RRF_SQL + """, m AS (SELECT query_id, id, score, key FROM vr WHERE rank <= 100 UNION ALL SELECT query_id, id, score, key FROM br WHERE rank <= 100),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, id) AS nth FROM m),
w AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM o WHERE nth = 1) SELECT * FROM w WHERE rank <= 50""")
def simple_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion that is switched on for ablations: raw scores, best first."""
    return asm.simple_merge([leg.select("query_id", "id", "score", "key") for leg in legs_by_text(spark, sf_dir).values()]).where("rank <= 50")


@add(RRF_SQL + """, b AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS best FROM vr WHERE rank <= 100)
SELECT query_id, id, score FROM b WHERE best >= 0.95""")
def set_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asm.set_floor(legs_by_text(spark, sf_dir)["vector"].select("query_id", "id", "score"), 0.95)


FORM_SQL = """t AS (SELECT doc_id, CASE WHEN doc_id % 13 > 0 THEN text END AS raw, CASE WHEN doc_id % 3 > 0 THEN left(text, 200) END AS summary, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS cover, doc_id % 2 = 0 AS inject,
 CASE doc_id % 4 WHEN 0 THEN ['Factual_Retrieval'] WHEN 1 THEN ['Ideation'] WHEN 2 THEN ['Ideation', 'Code_Change'] ELSE [] END AS intents, ['thtions', 'ungheit'] AS kw FROM documents),
k AS (SELECT *, len(list_filter(kw, lambda w: contains(lower(raw), w) OR contains(lower(raw), rtrim(w, 's')))) > 0 AS in_raw, len(list_filter(kw, lambda w: contains(lower(summary), w) OR contains(lower(summary), rtrim(w, 's')))) > 0 AS in_sum,
 list_has_any(intents, ['Factual_Retrieval', 'Utility_Formatting', 'Troubleshooting', 'Code_Change']) AS exact, list_has_any(intents, ['Casual_Banter', 'Ideation', 'Open_Exploration', 'Emotional_Processing']) AS loose FROM t),
c AS (SELECT *, CASE WHEN coalesce(length(raw), 0) = 0 THEN CASE WHEN coalesce(length(summary), 0) > 0 THEN 'summary' ELSE 'none' END
 WHEN coalesce(length(summary), 0) = 0 THEN CASE WHEN inject THEN 'raw' ELSE 'head' END WHEN cover < 0.7 THEN 'raw' WHEN in_raw AND NOT in_sum THEN 'raw'
 WHEN loose AND NOT exact THEN 'summary' WHEN exact OR inject THEN 'both' ELSE 'summary' END AS form FROM k)"""


@add(f"""WITH {FORM_SQL} SELECT doc_id, sha256(CASE form WHEN 'summary' THEN summary WHEN 'head' THEN left(raw, 300) WHEN 'none' THEN NULL ELSE raw END) AS text_sha, sha256(CASE WHEN form = 'both' THEN summary END) AS degrade_sha,
CASE WHEN form IN ('both', 'summary') THEN 'a' || doc_id END AS abstract FROM c""")
def representation_chooser(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    none = F.lit(None).cast("string")
    intents = F.when(d % 4 == 0, F.array(F.lit("Factual_Retrieval"))).when(d % 4 == 1, F.array(F.lit("Ideation"))).when(d % 4 == 2, F.array(F.lit("Ideation"), F.lit("Code_Change"))).otherwise(F.array().cast("array<string>"))
    made = asm.representation(
        F.when(d % 13 > 0, F.col("text")), F.when(d % 3 > 0, F.substr("text", F.lit(1), F.lit(200))), F.concat(F.lit("a"), d.cast("string")),
        F.when(d % 5 > 0, (d % 100) / 100), d % 2 == 0, F.array(F.lit("thtions"), F.lit("ungheit")), intents,
    )
    rows = read(spark, sf_dir, "documents").select("doc_id", made.alias("m"))
    return rows.select("doc_id", F.sha2(F.coalesce("m.text", none), 256).alias("text_sha"), F.sha2("m.degrade", 256).alias("degrade_sha"), F.col("m.abstract").alias("abstract"))


@add(f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS w FROM documents), c AS (SELECT doc_id, n AS chunk, array_to_string(w[n * 60 + 1 : n * 60 + 60], ' ') AS text FROM d, range(0, 1000) r(n) WHERE n * 60 < len(w)),
h AS (SELECT *, len(list_filter(['thtions', 'ung', 'ede'], lambda k: contains(lower(text), k) OR contains(lower(text), rtrim(k, 's')))) AS hits FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk) AS nth, max(hits) OVER (PARTITION BY doc_id) AS most FROM h)
SELECT doc_id, sha256(string_agg(text, chr(10) || '[…]' || chr(10) ORDER BY chunk)) AS sha FROM r WHERE nth <= CASE WHEN most > 0 THEN 2 ELSE 1 END GROUP BY 1""")
def doc_chunk_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of sixty words, asked by three keywords."""
    d = read(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    chunks = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 60).cast("int"))).alias("chunk"))
    rows = chunks.select(F.lit(0).alias("query_id"), "doc_id", "chunk", F.array_join(F.slice("w", F.col("chunk") * 60 + 1, 60), " ").alias("text"), F.array(*map(F.lit, ("thtions", "ung", "ede"))).alias("keywords"))
    return asm.pick_chunks(rows).select("doc_id", F.sha2("text", 256).alias("sha"))


@add(rf"""WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '') AS w, contains(lower(text), 'ungheit') AS hit FROM documents), n AS (SELECT *, CASE WHEN hit THEN 1500 ELSE 500 END AS cap FROM d),
k AS (SELECT *, array_to_string(w[1:cap], ' ') AS kept FROM n), e AS (SELECT *, regexp_extract(kept, '^(.*[.!?])', 1, 's') AS whole FROM k),
b AS (SELECT *, CASE WHEN len(w) <= cap THEN text WHEN length(whole) > 0.6 * length(kept) THEN whole ELSE kept END AS body FROM e)
SELECT doc_id AS id, sha256('[' || strftime(DATE '2024-01-01' + (doc_id % 28)::INT, '%Y-%m-%d') || '] ' || body) AS sha, CASE WHEN doc_id % 10 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS score FROM b WHERE length(body) > 0""")
def rows_to_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        d.alias("id"), "text", F.array(F.lit("ungheit")).alias("keywords"), F.lit(1.0).alias("score"), (d % 10 == 0).alias("is_bookmarked"), F.date_add(F.lit("2024-01-01").cast("date"), (d % 28).cast("int")).alias("day")
    )
    return asm.fragments(rows).select("id", F.sha2("text", 256).alias("sha"), "score")


@add(f"""WITH {TURNS_SQL}, t AS (SELECT conversation_id, turn_id, us, floor(value * 30)::BIGINT AS tokens, CASE WHEN k % 3 > 0 THEN floor(value * 6)::BIGINT END AS summary_tokens, CASE WHEN k % 2 = 0 THEN 20 END AS abstract_tokens FROM turns),
o AS (SELECT *, row_number() OVER w AS nth, CASE WHEN lag(us) OVER w - us >= 7200000000 THEN 1 ELSE 0 END AS pause FROM t WINDOW w AS (PARTITION BY conversation_id ORDER BY us DESC, turn_id DESC)),
g AS (SELECT *, sum(pause) OVER (PARTITION BY conversation_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS before FROM o WHERE nth <= 40), s AS (SELECT *, count(*) FILTER (before = 0) OVER (PARTITION BY conversation_id) AS sitting FROM g),
f AS (SELECT *, CASE WHEN tokens <= 1400 THEN 'raw' WHEN summary_tokens <= 1400 THEN 'summary' WHEN abstract_tokens <= 1400 THEN 'abstract' ELSE 'cut' END AS form FROM s WHERE nth <= sitting + 1),
c AS (SELECT *, CASE form WHEN 'raw' THEN tokens WHEN 'summary' THEN summary_tokens WHEN 'abstract' THEN abstract_tokens ELSE 1400 END::BIGINT AS cost FROM f),
u AS (SELECT *, sum(cost) OVER (PARTITION BY conversation_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS used FROM c)
SELECT conversation_id, turn_id, nth::INT AS nth, form, cost FROM u WHERE nth = 1 OR used <= 4000""")
def recent_window_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select(
        "conversation_id", "turn_id", "us", F.floor(F.col("value") * 30).alias("tokens"), F.when(F.col("k") % 3 > 0, F.floor(F.col("value") * 6)).alias("summary_tokens"), F.when(F.col("k") % 2 == 0, F.lit(20)).alias("abstract_tokens")
    )
    # events are far apart, so a sitting here ends with two hours
    return asm.recent_window(t, 4000, gap_us=7_200_000_000)


@add("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS users FROM conversations),
p AS (SELECT conv_id AS request, 1 AS at_, 0 AS place, 'Answer from what you remember.' AS text FROM conversations GROUP BY 1
UNION ALL SELECT c.conv_id, 2 + r_regionkey % 3, r_regionkey, r_name || ': on' FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN region ON r_regionkey % 5 = c.conv_id % 5 OR r_regionkey = 0
UNION ALL SELECT conv_id, 8, turn, role || ': ' || text FROM m WHERE back <= 4 AND NOT (role = 'user' AND users = 1)
UNION ALL SELECT conv_id, 10, turn, text FROM m WHERE role = 'user' AND users = 1)
SELECT request, sha256(string_agg(text, chr(10) || chr(10) ORDER BY at_, place)) AS sha, count(*) AS n_parts FROM p WHERE length(text) > 0 GROUP BY 1""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their last turns, the newest question and the slots of regions."""
    c = read(spark, sf_dir, "conversations").where("conv_id is not null")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = F.count(F.when(F.col("role") == "user", 1)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    m = c.withColumn("back", F.row_number().over(back)).withColumn("users", users)
    asks = (F.col("role") == "user") & (F.col("users") == 1)
    one = c.select("conv_id").distinct()
    part = lambda rows, section, place, text: rows.select(F.col("conv_id").alias("request"), section.alias("section"), place.cast("int").alias("place"), text.alias("text"))
    slots = read(spark, sf_dir, "region")
    slots = F.broadcast(slots) if slots.count() <= 10_000 else slots
    tier = F.element_at(F.array(*map(F.lit, asm.SECTIONS[1:4])), (F.col("r_regionkey") % 3 + 1).cast("int"))
    with_slots = one.join(slots, (F.col("r_regionkey") % 5 == F.col("conv_id") % 5) | (F.col("r_regionkey") == 0))
    parts = (
        part(one, F.lit("system"), F.lit(0), F.lit("Answer from what you remember."))
        .unionByName(part(with_slots, tier, F.col("r_regionkey"), F.concat("r_name", F.lit(": on"))))
        .unionByName(part(m.where((F.col("back") <= 4) & ~asks), F.lit("recent"), F.col("turn"), F.concat_ws(": ", "role", "text")))
        .unionByName(part(m.where(asks), F.lit("question"), F.col("turn"), F.col("text")))
    )
    return asm.assemble(parts).select("request", F.sha2("prompt", 256).alias("sha"), "n_parts")


@add("""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g') AS t FROM conversations),
s AS (SELECT conv_id, turn, left(t, 20) AS a, substr(t, 21, 20) AS b, turn % 4 AS cut_ FROM c)
SELECT conv_id, turn, a || CASE WHEN cut_ = 0 THEN b WHEN cut_ = 1 THEN b ELSE '' END AS text, (CASE WHEN cut_ = 3 THEN 3 ELSE 4 END)::INT AS lines,
((length(a) > 0)::INT + (cut_ = 0 AND length(b) > 0)::INT)::INT AS parsed, ((length(a) = 0)::INT + 2 + (cut_ = 0 AND length(b) = 0)::INT)::INT AS no_content, (cut_ = 1)::INT AS salvaged, (cut_ = 2)::INT AS dropped FROM s""")
def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as event streams of two deltas, a role and a usage line; the second delta is whole, cut after its content, cut inside it, or absent."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z ]", "").alias("t"))
    delta = lambda x: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), x, F.lit('"}}]}'))
    a, b, cut_ = F.substr("t", F.lit(1), F.lit(20)), F.substr("t", F.lit(21), F.lit(20)), F.col("turn") % 4
    second = F.when(cut_ == 0, delta(b)).when(cut_ == 1, F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), b, F.lit('"'))).when(cut_ == 2, F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), b))
    stream = F.concat_ws("\n", F.lit('data: {"choices":[{"delta":{"role":"assistant"}}]}'), F.lit(""), delta(a), F.lit(": note"), second, F.lit('data: {"choices":[]}'), F.lit("data: [DONE]"))
    return c.select("conv_id", "turn", asm.parse_stream(stream).alias("s")).select("conv_id", "turn", "s.*")


@add(f"""WITH {EDGES_SQL}, l AS (SELECT source, relation, strength / 10 AS trust FROM edges WHERE valid_until IS NULL),
g AS (SELECT source % 50 AS query_id, source AS anchor, avg(trust) AS mean, bool_or(relation = CASE WHEN source % 50 % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END) AS hit FROM l GROUP BY ALL),
r AS (SELECT query_id, anchor, round(1 + least(0.5, 0.25 * mean) + CASE WHEN hit THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor)::INT AS rank FROM r) SELECT * FROM k WHERE rank <= 5""")
def graph_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as anchors of fifty queries, by the strength of their live edges."""
    e = edges(spark, sf_dir).where("valid_until is null")
    q = F.col("source") % 50
    facts = e.select(q.alias("query_id"), F.col("source").alias("anchor"), (F.col("strength") / 10).alias("trust"), "relation", F.when(q % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("asked"))
    return asm.graph_leg(facts)


@add("""WITH e AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS topic, (user_id % 100) / 100.0::DOUBLE AS intent, event_id % 20000 AS budget FROM events)
SELECT event_id, CASE WHEN topic < 0.35 AND intent < 0.35 THEN greatest(1500, floor(budget * 0.3::DOUBLE)) END::BIGINT AS budget FROM e""")
def wide_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = asm.wide_net_budget(F.col("event_id") % 100 / 100, F.col("user_id") % 100 / 100, F.col("event_id") % 20000)
    return read(spark, sf_dir, "events").select("event_id", made.alias("budget"))


@add(f"""WITH {V_SQL}, s AS (SELECT query_id, vec_id AS id, round(list_dot_product(qe, e), 6) AS score FROM q, v WHERE vec_id % 17 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
w AS (SELECT DISTINCT query_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word, lower(text) AS low FROM q JOIN documents ON doc_id = query_id),
n AS (SELECT p_partkey AS entity_id, lower(p_name) AS name, string_split_regex(lower(p_name), '[^\\p{{L}}\\p{{N}}]+')[1] AS word FROM part)
SELECT query_id, 'turn' AS kind, id FROM r WHERE rank <= 5 UNION ALL SELECT DISTINCT query_id, 'entity', entity_id FROM w JOIN n USING (word) WHERE contains(low, name)""")
def forget_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request to forget may mean: the five nearest visible turns, and the entities it names."""
    from engram.functions import vectors

    v = read(spark, sf_dir, "embeddings")
    q = prompts(spark, sf_dir)
    near = vectors.block_topk(v.where("vec_id % 17 > 0"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, "vec_id", "embedding")
    named = asm.named_in(q.select("query_id", "text"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")))
    return near.select("query_id", F.lit("turn").alias("kind"), "id").unionByName(named.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id")))


def _ablated_sql() -> str:
    part = "SELECT '{off}' AS off, query_id, arg_min(id, (nth, rank, id)) AS id, round(sum(w::DOUBLE / (60 + rank)), 9) AS score FROM u WHERE leg <> '{off}' GROUP BY query_id, key"
    return RRF_SQL + ", a AS (" + " UNION ALL ".join(part.format(off=off) for off in ("none", "bm25", "vector")) + """),
x AS (SELECT *, row_number() OVER (PARTITION BY off, query_id ORDER BY score DESC, id)::INT AS rank FROM a) SELECT * FROM x WHERE rank <= 10"""


@add(_ablated_sql())
def ablation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best with all legs, and with each leg switched off."""
    legs, out = legs_by_text(spark, sf_dir), None
    for off in ("none", *legs):
        kept = {name: leg for name, leg in legs.items() if name != off}
        made = asm.fuse(kept, rt.BASE_WEIGHTS, 10).select(F.lit(off).alias("off"), "query_id", "id", "score", "rank")
        out = made if out is None else out.unionByName(made)
    return out
