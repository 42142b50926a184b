"""Turning messages and documents into turns, sections and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.lineage import cut


def pair_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, pair, prompt, response) of messages (conv_id, turn, role, text).

    System messages are dropped, runs of one role are merged with a blank line, a
    leading assistant message is skipped, a trailing user message gets an empty answer.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    kept = messages.where(F.col("role").isin("user", "assistant"))
    runs = kept.withColumn("new", (F.col("role") != F.lag("role", 1, "").over(order)).cast("int")).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = runs.groupBy("conv_id", "run", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )
    by_run = Window.partitionBy("conv_id").orderBy("run")
    return (
        merged.withColumn("next", F.lead("text").over(by_run))
        .where("role = 'user'")
        .select("conv_id", F.row_number().over(by_run).alias("pair"), F.col("text").alias("prompt"), F.coalesce("next", F.lit("")).alias("response"))
    )


def synthesise_times(pairs: DataFrame, anchor_us: int, step_us: int = 60_000_000) -> DataFrame:
    """Pairs without times end at the anchor and lie a minute apart."""
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return pairs.withColumn("us", F.lit(anchor_us) - (n - F.col("pair")) * step_us)


def fill_times(rows: DataFrame, anchor_us: int, step_us: int = 60_000_000) -> DataFrame:
    """Missing times of (conv_id, pos, us): a minute before the first known, a minute after the last before.

    Without any known time the conversation ends at the anchor.  The times are then
    made to rise by a second at least; the running maximum of (time - position
    seconds) does that without a sequential pass.
    """
    order = Window.partitionBy("conv_id").orderBy("pos")
    whole = Window.partitionBy("conv_id")
    last = F.last(F.when(F.col("us").isNotNull(), F.struct("pos", "us")), ignorenulls=True).over(order)
    first = F.min(F.when(F.col("us").isNotNull(), F.struct("pos", "us"))).over(whole)
    filled = F.coalesce(
        "us", last["us"] + (F.col("pos") - last["pos"]) * step_us, first["us"] - (first["pos"] - F.col("pos")) * step_us,
        F.lit(anchor_us) - (F.max("pos").over(whole) - F.col("pos")) * step_us,
    )
    second = F.lit(1_000_000)
    return rows.withColumn("us", filled).withColumn(
        "us", F.max(F.col("us") - F.col("pos") * second).over(order) + F.col("pos") * second
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The smallest id of each text; a map-side aggregation on the hash, never a window over a hot text."""
    return docs.groupBy(F.sha2(text_col, 256).alias("sha")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def combine_sources(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """First row of each key in the stated order, with the number of rows it stands for."""
    best = F.min_by(F.struct("*"), F.struct(*order))
    return rows.withColumn("key", key).groupBy("key").agg(best.alias("r"), F.count("*").alias("n")).select("r.*", "n")


def quota_sample(rows: DataFrame, bucket: str, share: float, id_col: str) -> DataFrame:
    """At most ``share`` of all rows from one bucket, lowest hash first: the same rows at every run."""
    total = rows.agg(F.count("*").alias("total"))
    order = Window.partitionBy(bucket).orderBy(F.md5(F.col(id_col).cast("string")), id_col)
    return (
        rows.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(total))  # one row
        .where(F.col("nth") <= F.floor(F.col("total") * share))
        .drop("nth", "total")
    )


def grouped_split(rows: DataFrame, group: str, stratum: str, test: float = 0.15, validation: float = 0.15) -> DataFrame:
    """(group, stratum, split): whole groups go to one split; floors of 15 % each of a group's dominant stratum."""
    counts = rows.groupBy(group, stratum).agg(F.count("*").alias("n"))
    owner = counts.groupBy(group).agg(F.max_by(stratum, F.struct("n", stratum)).alias(stratum))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(group).cast("string")), group)
    n = F.count("*").over(Window.partitionBy(stratum))
    at = F.row_number().over(order)
    tests, checks = F.floor(n * test), F.floor(n * validation)
    split = F.when(at <= tests, "test").when(at <= tests + checks, "validation").otherwise("train")
    return owner.select(group, stratum, split.alias("split"))


def describe(rows: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row a column: type, nulls, distinct values, min, max and mean; all from one aggregation."""
    parts = []
    for c in numeric:
        parts += [F.count_if(F.col(c).isNull()), F.countDistinct(c), F.min(c).cast("double"), F.max(c).cast("double"), F.round(F.avg(c), 4)]
    for c in text:
        parts += [F.count_if(F.col(c).isNull()), F.countDistinct(c), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")]
    named = [p.alias(f"x{n}") for n, p in enumerate(parts)]
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit("number" if c in numeric else "text").alias("kind"),
            *[F.col(f"x{5 * n + i}").alias(name) for i, name in enumerate(("nulls", "n_distinct", "low", "high", "mean"))],
        )
        for n, c in enumerate(numeric + text)
    ])
    return rows.agg(*named).select(F.inline(lines))


def top_values(rows: DataFrame, column: str, k: int = 5) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    # each task hands on its own first k, so the ranks are given to k rows
    first = counts.orderBy(F.desc("n"), column).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def sums_before(rows: DataFrame, order: list[str], n: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``n`` over all rows before them in a global order.

    Rows are dealt by ranges; sums inside a range and the totals of the ranges (one number each) make the result, so no task sees all rows.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    starts, total = [], 0
    for part, size in sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum(n)).collect()):
        starts.append(F.struct(F.lit(part).cast("long"), F.lit(total).cast("long")))
        total += size
    start = F.element_at(F.map_from_entries(F.array(*starts)), F.col("__part")) if starts else F.lit(0)
    inside = F.sum(n).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("before", (start + F.coalesce(inside, F.lit(0))).cast("long")).drop("__at", "__part")


def lowest(rows: DataFrame, digest: Column, id_col: str, n: int) -> DataFrame:
    """The n rows with the lowest (hexadecimal digest, id), without a sort of all rows.

    A histogram of the digests' first four digits (65,536 counts at most) tells which rows are in for
    certain; only the rows of the one bucket at the border are ranked.
    """
    marked = rows.withColumn("__digest", digest).withColumn("__bucket", F.substr("__digest", F.lit(1), F.lit(4)))
    counts = sorted(tuple(r) for r in marked.groupBy("__bucket").agg(F.count("*")).collect())
    border, left = None, n
    for bucket, size in counts:
        if size > left:
            border = bucket
            break
        left -= size
    if border is None:
        return rows
    inside = marked.where(F.col("__bucket") < border)
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy("__digest", id_col))
    at_border = marked.where(F.col("__bucket") == border).withColumn("__nth", nth).where(F.col("__nth") <= left)
    return inside.select(rows.columns).unionByName(at_border.select(rows.columns))


def stride_sample(rows: DataFrame, order_col: str, head: int = 25, total: int = 50) -> DataFrame:
    """The first ``head`` rows and evenly spaced others, ``total`` at most.

    Positions come from one dealing by ranges that is written before anything is counted, so no task
    sorts the whole table and all that is joined agrees, whatever columns are carried along.
    """
    placed = sums_before(rows.withColumn("__one", F.lit(1)), [order_col], "__one").withColumn("__nth", F.col("before") + 1)
    size = placed.agg(F.count("*").alias("__size"))
    step = F.greatest(F.lit(1), F.floor((F.col("__size") - head) / (total - head)))
    pick = (F.col("__nth") <= head) | (((F.col("__nth") - head - 1) % step == 0) & ((F.col("__nth") - head - 1) / step < total - head))
    return placed.join(F.broadcast(size)).where(pick).select(*rows.columns, F.col("__nth").alias("nth"))  # size is one row


def context_rows(pairs: DataFrame, back: int = 3) -> DataFrame:
    """Every prompt with its last three exchanges."""
    window = Window.partitionBy("conv_id").orderBy("pair").rowsBetween(-back, -1)
    return pairs.withColumn("context", F.array_join(F.collect_list(F.concat_ws("\n", "prompt", "response")).over(window), "\n"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, section, n_sections, header, text): one section a line block, with its header."""
    blocks = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("section", "text"))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return blocks.withColumn("n_sections", n).withColumn(
        "header", F.format_string("[doc %d · section %d/%d]", "doc_id", F.col("section") + 1, "n_sections")
    )
