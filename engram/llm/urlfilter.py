"""URL filtering by association rules (DataFrame and MLlib operations only).

URLs of labelled rows become transactions of URL tokens plus a label item;
Spark's FP-growth mines token combinations, and the rules that conclude "block"
with enough support and confidence are kept.  Rules match through an inverted
index: each rule is posted once, under its rarest token, and a posting counts
only if the URL holds the whole combination.  Stated host-and-path rules come
first; the longest that fits decides.

Defined results
---------------
* Null urls, and urls without ``://``, have an empty host and path, no tokens, no
  rule, and are allowed.
* Every row gets a verdict; repeated rows get it each.  Extra columns are ignored.
* Labels without a page, and pages without a label, train nothing.  Without
  labels, or without a blocking rule, whatever no stated rule decides is allowed.
* An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import cut, table
from engram.llm.neardup import split_join

#: Stated rules: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_SUPPORT = 0.002
MIN_COUNT = 4
MIN_CONFIDENCE = 0.6
BLOCK_ITEM = "label=block"
#: Tables of rules and of frequent tokens are broadcast up to this many (counted) rows.
BROADCAST_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host with A-Z lower-cased; both empty for null urls and urls without ://."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host, each domain suffix, host labels, path words, query keys."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.lit("domain="), F.array_join(F.slice(labels, n, F.size(labels)), ".")),
    )
    words = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\d+", "#")),
    )
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    bits = F.transform(
        F.filter(F.split(F.element_at(labels, 1), "-"), lambda x: F.size(F.split(F.element_at(labels, 1), "-")) > 1),
        lambda x: F.concat(F.lit("bit="), x),
    )
    tokens = F.array_distinct(F.concat(suffixes, words, keys, bits))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tokens)


def stated_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest stated rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        text = F.when(fits, F.lit(domain + prefix)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def folded(transactions: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((items) over classes of tokens, classes (token, members, freq)) of ``transactions`` (tokens, bad).

    Tokens of exactly the same transactions (the words of one long path, say) are one class, named by
    its least token: a url with n such words has one itemset of them instead of 2^n.  A token
    is told by the number and two sums over hashes of its transactions.  Tokens of fewer than
    ``least`` transactions are in no rule and are left out.
    """
    rows = cut(transactions.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"))
    held = rows.select("row", "bad", F.explode("tokens").alias("token"))
    told = held.groupBy("token").agg(
        F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(20,0)")).alias("y")
    )
    classes = told.where(F.col("freq") >= least).groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members"))
    classes = cut(classes.select(F.element_at("members", 1).alias("token"), "members", "freq"))
    # few tokens are that frequent: no more than the mean number of tokens over the least support
    named = classes.select("token", F.lit(True).alias("named"))
    kept = held.join(F.broadcast(named) if named.count() <= BROADCAST_ROWS else named, "token", "left")
    items = F.collect_list(F.when(F.col("named"), F.col("token")))
    return kept.groupBy("row", "bad").agg(items.alias("items")).select(F.when(F.col("bad"), F.array_append("items", BLOCK_ITEM)).otherwise(F.col("items")).alias("items")), classes


def mine_rules(
    transactions: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(rule_id, antecedent, index_token, confidence) of the rules that conclude "block", from ``transactions`` (tokens, bad).

    An antecedent is a list of classes of tokens; it fits a url that holds any token of each.  A rule
    stands in the index under every token of its rarest class.
    """
    n = transactions.count()
    if not n:
        return transactions.sparkSession.createDataFrame([], "rule_id long, antecedent array<array<string>>, index_token string, confidence double")
    support = min(1.0, max(min_support, min_count / n))
    items, classes = folded(transactions, math.ceil(support * n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK_ITEM).select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.explode("antecedent").alias("token"), "confidence"
    )
    unfolded = rules.join(classes, "token").groupBy("rule_id", "confidence").agg(
        F.collect_list("members").alias("antecedent"), F.min_by("members", F.struct("freq", "token")).alias("rarest")
    )
    return unfolded.select("rule_id", "antecedent", F.explode("rarest").alias("index_token"), "confidence")


def filter_urls(
    pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of ``pages`` (page_id, url).

    ``labelled`` holds (url, bad): the urls that train, with a boolean label.
    """
    host, path = url_parts(F.col("url"))
    transactions = cut(labelled.where("bad is not null").select(url_tokens(F.col("url"), host, path).alias("tokens"), "bad").where(F.size("tokens") > 0))
    mined = cut(mine_rules(transactions, min_support, min_count, min_confidence))
    entries = mined.count()

    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("stated"))
    # only urls that no stated rule settles are looked up; null and foreign ones (all alike) meet no join
    open_ = F.col("stated").isNull() & (F.col("host") != "")
    settled = (parsed.where(~open_) if entries else parsed).withColumn("confidence", F.lit(None).cast("double"))
    out = settled
    if entries:
        open_rows = cut(parsed.where(open_))
        open_urls = open_rows.select("url", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).distinct()
        fits = F.forall("antecedent", lambda members: F.arrays_overlap(members, F.col("tokens")))
        blocked = (
            open_urls.select("url", "tokens", F.explode("tokens").alias("index_token"))
            .join(F.broadcast(mined) if entries <= BROADCAST_ROWS else mined, "index_token")
            .where(fits)
            .groupBy("url")
            .agg(F.max("confidence").alias("confidence"))
        )
        told = open_urls.select("url").join(blocked, "url", "left")
        # one url may have very many pages
        out = settled.unionByName(split_join(open_rows, told, "url").select(*settled.columns))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("stated", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "confidence",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return filter_urls(pages, pages.join(labels, "page_id").select("url", "bad"))
