"""Seams: slices of a dump joined where they overlap, and overlapping spans of several taggers made one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a slice's end that are held against the next one's beginning.
SEAM_TURNS = 3
MINUTE_US = 60_000_000


def plain(text: Column) -> Column:
    """What two readings of one turn share: letters and digits in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def joined_at_seams(turns: DataFrame, seam: int = SEAM_TURNS) -> DataFrame:
    """(title, pos, role, text, us) of turns (title, slice, nth, role, text, mtime_us), in order, a minute apart up to the dump's time.

    A slice's last turns are aligned with the first ones of the next: the longest run, of ``seam`` turns at most, that is the
    same in both is there once.  The cut may go through a turn, so the last turn of a slice may be the
    beginning of its counterpart, and the first of the next one the end of it; the longer reading stays.
    Nothing else is dropped: a turn that is said twice stays twice.  Null texts are empty.
    """
    own = Window.partitionBy("title", "slice").orderBy("nth")
    size = F.count("*").over(Window.partitionBy("title", "slice"))
    rows = turns.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("at", F.row_number().over(own)).withColumn("back", size - F.col("at"))
    turn = F.struct("at", "back", "role", "text", plain(F.col("text")).alias("plain"))
    ends = rows.groupBy("title", "slice").agg(
        F.array_sort(F.collect_list(F.when(F.col("at") <= seam, turn))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("back") < seam, turn))).alias("tail")
    )
    before = Window.partitionBy("title").orderBy("slice")
    pairs = ends.select("title", "slice", "head", F.lag("slice").over(before).alias("last"), F.lag("tail").over(before).alias("tail")).where("last is not null")

    def fits(n: int) -> Column:
        tail, head = F.slice("tail", F.size("tail") - n + 1, n), F.slice("head", 1, n)
        met = F.zip_with(tail, head, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        same = lambda x: (x["a"]["role"] == x["b"]["role"]) & (
            (x["a"]["plain"] == x["b"]["plain"])
            | ((x["a"]["back"] == 0) & (x["a"]["plain"] != "") & F.startswith(x["b"]["plain"], x["a"]["plain"]))
            | ((x["b"]["at"] == 1) & (x["b"]["plain"] != "") & F.endswith(x["a"]["plain"], x["b"]["plain"]))
        )
        return (F.size("tail") >= n) & (F.size("head") >= n) & F.forall(met, same)

    overlap = F.lit(0)
    for n in range(1, seam + 1):
        overlap = F.when(fits(n), n).otherwise(overlap)
    pairs = pairs.withColumn("overlap", overlap).where("overlap > 0")
    dropped = pairs.select("title", "slice", "overlap")
    tail, head = F.slice("tail", F.size("tail") - F.col("overlap") + 1, F.col("overlap")), F.slice("head", F.lit(1), F.col("overlap"))
    longer = F.zip_with(tail, head, lambda a, b: F.struct(a["at"].alias("at"), F.when(F.length(b["text"]) > F.length(a["text"]), b["text"]).otherwise(a["text"]).alias("whole")))
    whole = pairs.select("title", F.col("last").alias("slice"), F.inline(longer))
    kept = rows.join(dropped, ["title", "slice"], "left").where("overlap is null or at > overlap").join(whole, ["title", "slice", "at"], "left")
    order = Window.partitionBy("title").orderBy("slice", "at")
    n = F.count("*").over(Window.partitionBy("title"))
    return kept.withColumn("pos", F.row_number().over(order)).select(
        "title", "pos", "role", F.coalesce("whole", "text").alias("text"), (F.col("mtime_us") - (n - F.col("pos")) * MINUTE_US).alias("us")
    )


def united_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, stop, label, score, text) of spans (id, start, stop, label, score) over texts (id, text): offsets in characters, from 0.

    Spans of all taggers are snapped out to whole words, trimmed of what is no letter or digit at either end, and those that
    overlap are one: it reaches from the first start to the last stop, and has the label and score of its
    best part.  Overlaps are told by the furthest stop so far, in one window, so a chain of any length is one
    span.  Spans that are empty, outside of the text or without a word are dropped.
    """
    inside = F.least(F.col("stop"), F.length("text")).alias("stop")
    rows = spans.join(texts, "id").where("text is not null and start is not null and stop is not null").select("id", "text", F.greatest(F.lit(0), "start").alias("start"), inside, "label", "score").where("start < stop")
    # what of a word lies before the start and after the stop; \z, since $ would also match before a last line feed
    ahead = F.length(F.regexp_extract(F.substr("text", F.lit(1), F.col("start")), r"([\p{L}\p{N}]*)\z", 1))
    behind = F.length(F.regexp_extract(F.substr("text", F.col("stop") + 1), r"^([\p{L}\p{N}]*)", 1))
    first, last = F.substr("text", F.col("start") + 1, F.lit(1)), F.substr("text", F.col("stop"), F.lit(1))
    word = r"[\p{L}\p{N}]"
    snapped = rows.withColumns({
        "from": F.col("start") - F.when(F.regexp(first, F.lit(word)), ahead).otherwise(0), "to": F.col("stop") + F.when(F.regexp(last, F.lit(word)), behind).otherwise(0),
    })
    part = F.substr("text", F.col("from") + 1, F.col("to") - F.col("from"))
    trimmed = snapped.withColumns({
        "start": F.col("from") + F.length(F.regexp_extract(part, r"^([^\p{L}\p{N}]*)", 1)), "stop": F.col("to") - F.length(F.regexp_extract(part, r"([^\p{L}\p{N}]*)\z", 1)),
    }).where("start < stop").select("id", "start", "stop", "label", "score")
    order = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = trimmed.withColumn("opens", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    numbered = opened.withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("stop") - F.col("start")).alias("width"), "label"))
    chains = numbered.groupBy("id", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), best.alias("b"))
    return chains.join(texts, "id").select("id", "start", "stop", "b.label", "b.score", F.substr("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))
