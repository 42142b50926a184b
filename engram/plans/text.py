"""Text and ingestion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import ingest
from engram.plans.base import Plans
from engram.sources.driver import NOW_US, read

PLANS = Plans()
add = PLANS.add


def _in(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def _any(column: str, cues) -> str:
    return "(" + " OR ".join(f"contains({column}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


def _hits(column: str, cues) -> str:
    return "(" + " + ".join(f"contains({column}, '{c}')::INT" for c in cues) + ")"


WS = r"[ \t\n\r\f\x0B]+"
PAIRS_SQL = """m AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
g AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM g),
u AS (SELECT conv_id, run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM r GROUP BY ALL),
n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY run) AS next FROM u),
pairs AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY run)::INT AS pair, text AS prompt, coalesce(next, '') AS response
          FROM n WHERE role = 'user')"""


@add(f"WITH {PAIRS_SQL} SELECT conv_id, pair, sha256(prompt) AS prompt_sha, sha256(response) AS response_sha FROM pairs")
def turn_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.pair_turns(read(spark, sf_dir, "conversations")).select(
        "conv_id", "pair", F.sha2("prompt", 256).alias("prompt_sha"), F.sha2("response", 256).alias("response_sha")
    )


@add(f"""WITH {PAIRS_SQL} SELECT conv_id, pair, {NOW_US} - (count(*) OVER (PARTITION BY conv_id) - pair) * 60000000 AS us FROM pairs""")
def ts_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.synthesise_times(ingest.pair_turns(read(spark, sf_dir, "conversations")), NOW_US).select("conv_id", "pair", "us")


@add("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.exact_dedup(read(spark, sf_dir, "documents"))


@add(f"""WITH k AS (SELECT *, substr(sha256(lower(trim(regexp_replace(text, '{WS}', ' ', 'g')))), 1, 20) AS key FROM documents WHERE n_chars >= 10)
SELECT arg_min(doc_id, (source, doc_id)) AS doc_id, arg_min(source, (source, doc_id)) AS source, key, count(*) AS n FROM k GROUP BY key""")
def corpus_combine_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("n_chars >= 10").select("doc_id", "source", tx.normalised_hash(F.col("text")).alias("key"))
    return ingest.combine_sources(docs, F.col("key"), ["source", "doc_id"]).select("doc_id", "source", "key", "n")


@add("""WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS nth, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM t WHERE nth <= floor(total * 0.22)""")
def bucket_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 0.22, "doc_id")


@add("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT user_id, arg_max(event_type, (n, event_type)) AS event_type FROM c GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(user_id::VARCHAR), user_id) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM o)
SELECT user_id, event_type, CASE WHEN place <= floor(n * 0.15) THEN 'test' WHEN place <= floor(n * 0.15) + floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split FROM p""")
def grouped_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.grouped_split(read(spark, sf_dir, "events"), "user_id", "event_type")


def _described(table: str, numeric, text) -> str:
    lines = [f"""SELECT '{c}' AS "column", 'number' AS kind, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, min({c})::DOUBLE AS low,
max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean FROM {table}""" for c in numeric]
    lines += [f"SELECT '{c}', 'text', count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL FROM {table}" for c in text]
    return " UNION ALL ".join(lines)


@add(_described("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def described_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.describe(read(spark, sf_dir, "part"), ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"])


@add("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand)::INT AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
def top_column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.top_values(read(spark, sf_dir, "part"), "p_brand")


@add("""WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS nth, count(*) OVER () AS size FROM orders),
s AS (SELECT *, greatest(1, floor((size - 25) / 25.0))::BIGINT AS step FROM t)
SELECT o_orderkey, nth FROM s WHERE nth <= 25 OR ((nth - 26) % step = 0 AND nth >= 26 AND (nth - 26) / step < 25)""")
def deterministic_row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.stride_sample(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "nth")


@add("""SELECT doc_id, floor(length(text) / 4)::BIGINT AS tokens, greatest(floor(length(text) / 4), floor(length(text) / 3))::BIGINT AS code_tokens FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(t).alias("tokens"), tx.code_token_estimate(t).alias("code_tokens"))


@add(rf"""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '{WS}')),
lambda w: w <> '' AND w NOT IN ({_in(tx.PROMPT_STOP_WORDS)}))), ' ') AS keywords FROM benchmark""")
def prompt_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.prompt_keywords(F.col("text")), " ").alias("keywords"))


@add(f"""WITH q AS (SELECT item_id, unnest(list_filter(list_distinct(string_split_regex(lower(text), '{WS}')), lambda w: length(w) > 2 AND w NOT IN ({_in(tx.PROMPT_STOP_WORDS)}))) AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '{WS}')) AS w FROM documents), h AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS nth FROM h) SELECT item_id, doc_id, hits FROM r WHERE nth <= 50""")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty documents that hold most of an item's words."""
    from engram.operators.retrieve import cap_per

    ask = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("w"))
    ask = ask.where((F.length("w") > 2) & ~F.col("w").isin(tx.PROMPT_STOP_WORDS))
    held = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("w"))
    hits = held.join(ask, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return cap_per(hits, ["item_id"], [F.desc("hits"), F.asc("doc_id")], 50)


WORDS = f"list_filter(string_split_regex(text, '{WS}'), lambda w: w <> '')"
ASCII = r"regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')"
ASCII_UNITS = r"regexp_replace(text, '[^\x00-\x7F€₹]', ' ', 'g')"
DENSITY_SQL = rf"""w AS (SELECT doc_id, text, {WORDS} AS words, list_distinct(regexp_extract_all({ASCII}, '\b([A-Z][a-zA-Z]{{2,}})\b', 1)) AS ents,
list_distinct(list_filter(list_transform(regexp_extract_all({ASCII_UNITS}, '{tx.FIGURE}', 0), lambda x: trim(x)), lambda x: length(x) > 1)) AS figs,
list_distinct(regexp_extract_all({ASCII}, '{tx.IDENTIFIER}', 0)) AS idents FROM documents),
p AS (SELECT *, greatest(len(words), 1) / 100.0::DOUBLE AS per100, list_transform(words[1:300], lambda w: lower(w)) AS win FROM w),
dens AS (SELECT doc_id, len(words) AS n_words, contains(text, '```') AS code, round(least(1.0, 0.45 * least(1.0, least(len(ents), 25) / per100 / 6)
 + 0.25 * least(1.0, (least(len(figs), 15) + least(len(idents), 15)) / per100 / 6) + 0.2 * contains(text, '```')::INT
 + 0.1 * len(list_distinct(win)) / greatest(len(win), 1)), 4) AS density FROM p)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.with_density(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@add(f"WITH {DENSITY_SQL} SELECT doc_id, n_words, density FROM dens")
def density_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("doc_id", "n_words", "density")


@add(f"""WITH {DENSITY_SQL} SELECT doc_id, CASE WHEN n_words <= 350 THEN 'short' WHEN code THEN 'code' WHEN doc_id % 5 = 0 THEN 'creative_continuity'
WHEN density >= 0.35 THEN 'dense_long' ELSE 'diffuse_long' END AS representation FROM dens""")
def representation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tx.representation(F.col("n_words"), F.col("density"), F.col("code"), F.col("doc_id") % 5 == 0, F.lit(False), 350, 0.35)
    return _dense(spark, sf_dir).select("doc_id", made.alias("representation"))


@add(rf"""WITH t AS (SELECT doc_id, left(text, 400) AS summary, regexp_extract_all({ASCII}, '\b([A-Z][a-zA-Z]{{2,}})\b', 1) AS found FROM documents),
f AS (SELECT doc_id, summary, list_filter(found, lambda x, i: list_position(found, x) = i)[1:25] AS terms FROM t)
SELECT doc_id, len(terms) AS n_terms, CASE WHEN len(terms) = 0 THEN 1.0 ELSE
 round(len(list_filter(terms, lambda t: contains(lower(summary), lower(t)))) / len(terms), 4) END AS coverage FROM f""")
def summary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "documents").select("doc_id", F.substr("text", F.lit(1), F.lit(400)).alias("summary"), tx.entities(F.col("text")).alias("terms"))
    return made.select("doc_id", F.size("terms").cast("long").alias("n_terms"), tx.summary_coverage(F.col("summary"), F.col("terms")).alias("coverage"))


# cue queries run on sentences made of the cue phrases, so that every branch is reached
CUE_TEXT_SQL = f"""p AS (SELECT unnest([{_in(tx.CONSTRAINT_CUES + tx.DECISION_CUES + tx.ERROR_CUES + tx.FIX_CUES)}]) AS cue),
c AS (SELECT cue, row_number() OVER (ORDER BY cue) - 1 AS nth FROM p),
s AS (SELECT e.event_id, 'Note ' || a.cue || ' and ' || b.cue || CASE WHEN e.event_id % 7 = 0 THEN ' ```never change```' ELSE '' END AS text
FROM events e JOIN c a ON a.nth = e.event_id % (SELECT count(*) FROM c) JOIN c b ON b.nth = (e.event_id * 7 + e.user_id) % (SELECT count(*) FROM c))"""


def _cue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = sorted(tx.CONSTRAINT_CUES + tx.DECISION_CUES + tx.ERROR_CUES + tx.FIX_CUES)
    all_ = F.array(*map(F.lit, cues))
    n = len(cues)
    a = F.element_at(all_, (F.col("event_id") % n + 1).cast("int"))
    b = F.element_at(all_, ((F.col("event_id") * 7 + F.col("user_id")) % n + 1).cast("int"))
    tail = F.when(F.col("event_id") % 7 == 0, " ```never change```").otherwise("")
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Note "), a, F.lit(" and "), b, tail).alias("text"))


@add(f"""WITH {CUE_TEXT_SQL}, l AS (SELECT event_id, lower(regexp_replace(text, '```.*?```', ' ', 'gs')) AS low FROM s)
SELECT event_id, CASE WHEN {_any('low', tx.CONSTRAINT_CUES)} THEN 'constraint' WHEN {_any('low', tx.ERROR_CUES)} AND {_any('low', tx.FIX_CUES)} THEN 'incident'
WHEN {_any('low', tx.DECISION_CUES)} THEN 'decision' END AS cue FROM l""")
def decision_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cue_text(spark, sf_dir).select("event_id", tx.decision_cue(F.col("text")).alias("cue"))


def _bucket_sql() -> str:
    hits = {b: _hits("low", c) for b, c in tx.BUCKET_CUES.items()}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    return "CASE WHEN " + best + " = 0 THEN 'general' " + " ".join(f"WHEN {h} = {best} THEN '{b}'" for b, h in hits.items()) + " END"


@add(f"""WITH {CUE_TEXT_SQL}, l AS (SELECT event_id, lower(text) AS low FROM s) SELECT event_id, {_bucket_sql()} AS bucket FROM l""")
def coarse_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cue_text(spark, sf_dir).select("event_id", tx.coarse_bucket(F.col("text")).alias("bucket"))


@add("SELECT conv_id, turn, sha256(concat_ws(':', conv_id::VARCHAR, turn::VARCHAR, coalesce(text, ''))) AS key FROM conversations")
def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.idempotency_key(F.col("conv_id"), F.col("turn"), F.col("text")).alias("key"))


@add(rf"""WITH w AS (SELECT doc_id, text, {WORDS} AS words FROM documents),
f AS (SELECT *, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1) AS odd,
 len(list_filter(range(1, greatest(len(words) - 2, 1)), lambda i: words[i] = words[i + 1] AND words[i] = words[i + 2] AND words[i] = words[i + 3])) AS runs FROM w)
SELECT doc_id, (length(text) < 40 OR odd > 0.08 OR coalesce(list_max(list_transform(words, lambda x: length(x))), 0) > 60
 OR (len(words) >= 12 AND (runs > 0 OR len(list_distinct(words)) / len(words) < 0.35))) AS degenerate FROM f""")
def degenerate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.is_degenerate(F.col("text")).alias("degenerate"))


@add(r"""WITH b AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS text,
generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), 1) - 1 AS section FROM documents)
SELECT doc_id, section::INT AS section, count(*) OVER (PARTITION BY doc_id) AS n_sections,
 '[doc ' || doc_id || ' · section ' || (section + 1) || '/' || count(*) OVER (PARTITION BY doc_id) || ']' AS header, sha256(text) AS text_sha FROM b""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sections(read(spark, sf_dir, "documents")).select("doc_id", "section", "n_sections", "header", F.sha2("text", 256).alias("text_sha"))


@add(f"""WITH {PAIRS_SQL}, c AS (SELECT conv_id, pair, string_agg(prompt || chr(10) || response, chr(10)) OVER (PARTITION BY conv_id ORDER BY pair ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS context FROM pairs)
SELECT conv_id, pair, sha256(coalesce(context, '')) AS context_sha FROM c""")
def context_prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = ingest.pair_turns(read(spark, sf_dir, "conversations"))
    return ingest.context_rows(pairs).select("conv_id", "pair", F.sha2("context", 256).alias("context_sha"))


@add(r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))
