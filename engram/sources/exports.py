"""Readers of chat exports: files become turns (provider, source_id, title, pos, role, text, us).

A file is read whole by Spark (``binaryFile``/``wholetext``); each conversation in it
is one row, so conversations are walked in parallel.  Branches that the reader's
path does not follow are dropped and counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS_SCHEMA = "provider string, source_id string, title string, pos int, role string, text string, us long, skipped int"
ROLES = {"user": "user", "human": "user", "REQUEST": "user", "assistant": "assistant", "RESPONSE": "assistant"}


def to_us(value) -> int | None:
    """Microseconds of an ISO text or a positive unix number; None for anything else."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value * 1_000_000) if value > 0 else None
    try:
        when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return int(when.replace(tzinfo=when.tzinfo or timezone.utc).timestamp() * 1_000_000)


def parse_time(text: Column) -> Column:
    """The same as a column expression, for JSON lines."""
    number = F.try_to_number(text, F.lit("9999999999.999999")).cast("double")
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), F.when(number > 0, (number * 1_000_000).cast("long")))


def sniff(head: str) -> str:
    """The format of an export by its keys: tree, flat, replies, lines; an error for none of them."""
    text = head.lstrip()
    if '"chat_messages"' in text:
        return "flat"
    if '"mapping"' in text:
        return "tree" if '"current_node"' in text else "replies"
    if text.startswith("{"):
        return "lines"
    raise ValueError("unknown export format")


def _chain(leaf: str | None, parent_of: dict[str, str | None]) -> list[str]:
    """Nodes from the root to a leaf; a loop ends the walk."""
    out: list[str] = []
    seen: set[str] = set()
    while leaf in parent_of and leaf not in seen:
        seen.add(leaf)
        out.append(leaf)
        leaf = parent_of[leaf]
    return out[::-1]


def read_tree(conv: dict) -> tuple[list[tuple], int]:
    """Turns on the path to the current node, and the messages off it."""
    nodes = conv.get("mapping") or {}
    path = _chain(conv.get("current_node"), {k: n.get("parent") for k, n in nodes.items()})

    def turn(node: dict) -> tuple | None:
        m = node.get("message") or {}
        role = ROLES.get((m.get("author") or {}).get("role"))
        parts = [p for p in (m.get("content") or {}).get("parts") or [] if isinstance(p, str) and p.strip()]
        hidden = (m.get("metadata") or {}).get("is_visually_hidden_from_conversation")
        return (role, "\n\n".join(parts), to_us(m.get("create_time"))) if role and parts and not hidden else None

    made = {k: t for k, n in nodes.items() if (t := turn(n))}
    return [made[k] for k in path if k in made], sum(k not in path for k in made)


def read_flat(conv: dict) -> tuple[list[tuple], int]:
    """Turns on the path to the latest message."""
    messages = {m["uuid"]: m for m in conv.get("chat_messages") or []}
    if not messages:
        return [], 0
    leaf = max(messages, key=lambda k: (messages[k].get("created_at") or "", k))
    path = _chain(leaf, {k: m.get("parent_message_uuid") for k, m in messages.items()})

    def text(m: dict) -> str:
        return m.get("text") or "\n\n".join(b.get("text") or "" for b in m.get("content") or [] if b.get("type") == "text")

    turns = [(ROLES.get(messages[k].get("sender")), text(messages[k]), to_us(messages[k].get("created_at"))) for k in path]
    return [t for t in turns if t[0] and t[1].strip()], len(messages) - len(path)


def read_replies(conv: dict) -> tuple[list[tuple], int]:
    """Turns from the root down, at each fork to the child whose subtree was written to last."""
    nodes = conv.get("mapping") or {}
    order, stack = [], [k for k, n in nodes.items() if n.get("parent") not in nodes]
    while stack:
        k = stack.pop()
        order.append(k)
        stack += [c for c in nodes[k].get("children") or [] if c in nodes]
    latest: dict[str, str] = {}
    for k in reversed(order):
        own = (nodes[k].get("message") or {}).get("inserted_at") or ""
        latest[k] = max([own, *(latest[c] for c in nodes[k].get("children") or [] if c in latest)])
    path, at = [], next((k for k in order), None)
    while at is not None:
        path.append(at)
        at = max((c for c in nodes[at].get("children") or [] if c in latest), key=lambda c: (latest[c], c), default=None)
    turns = []
    for k in path:
        m = nodes[k].get("message") or {}
        for role in ("REQUEST", "RESPONSE"):
            text = "\n\n".join(f.get("content") or "" for f in m.get("fragments") or [] if f.get("type") == role)
            if text.strip():
                turns.append((ROLES[role], text, to_us(m.get("inserted_at"))))
    return turns, sum(bool(nodes[k].get("message")) and k not in path for k in order)


READERS = {"tree": (read_tree, "chatgpt"), "flat": (read_flat, "claude"), "replies": (read_replies, "deepseek")}


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Turns of all JSON exports below a path; each file's format is sniffed from its head."""
    files = spark.read.text(path, wholetext=True)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["value"]:
                kind = sniff(text)
                if kind == "lines":
                    raise ValueError("JSON lines are read by read_jsonl")
                made = json.loads(text)
                rows += [(kind, json.dumps(c)) for c in (made if isinstance(made, list) else [made])]
            yield pd.DataFrame(rows, columns=["kind", "conversation"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TURNS_SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for kind, text in zip(frame["kind"], frame["conversation"], strict=True):
                conv, (reader, provider) = json.loads(text), READERS[kind]
                turns, skipped = reader(conv)
                ident = str(conv.get("uuid") or conv.get("id") or conv.get("conversation_id") or conv.get("title") or "")
                rows += [(provider, ident, conv.get("title") or conv.get("name"), n, role, body, us, skipped) for n, (role, body, us) in enumerate(turns)]
            yield pd.DataFrame(rows, columns=names).astype({"us": "Int64"})

    # conversations are dealt anew: one file may hold most of them
    return files.mapInPandas(split, "kind string, conversation string").repartition(F.xxhash64("conversation")).mapInPandas(walk, TURNS_SCHEMA)


LINE = "role string, content string, timestamp string, conversation string, conversation_id string, title string, prompt string, response string"


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines that are no JSON objects, counted from 1; a file is a row here, so this is for files that did not parse."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "text"))
    broken = (F.trim("text") != "") & (F.get_json_object("text", "$").isNull() | ~F.startswith(F.trim("text"), F.lit("{")))
    return files.where(broken).select("file", (F.col("at") + 1).alias("line"))


def read_jsonl(spark: SparkSession, path: str, salvage: bool = False) -> DataFrame:
    """Turns of JSON lines, as messages (role, content) or pairs (prompt, response); a bad line is an error that names it.

    When salvaging, bad lines are dropped, and ``skipped`` holds their number.
    """
    raw = spark.read.schema(LINE + ", bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    skipped = raw.agg(F.count_if(F.col("bad").isNotNull() & (F.col("role").isNull() | F.col("role").isNotNull()))).first()[0]
    if skipped and not salvage:
        file, line = bad_lines(spark, path).orderBy("file", "line").first()
        raise ValueError(f"line {line} of {file} is no JSON object")
    rows = raw.where(F.col("bad").isNull()).withColumn("line", F.monotonically_increasing_id())
    conv = F.coalesce("conversation", "conversation_id", F.lit("default"))
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text")), F.struct(F.lit("assistant").alias("role"), F.coalesce("response", F.lit("")).alias("text")))
    one = F.array(F.struct("role", F.col("content").alias("text")))
    made = rows.select(conv.alias("source_id"), "title", "line", parse_time(F.col("timestamp")).alias("us"), F.posexplode(F.when(F.col("prompt").isNotNull(), pair).otherwise(one)).alias("n", "x"))
    kept = made.where(F.col("x.role").isin("user", "assistant"))
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("line", "n")
    return kept.select(
        F.lit("jsonl").alias("provider"), "source_id", "title", (F.row_number().over(order) - 1).alias("pos"), F.col("x.role").alias("role"), F.col("x.text").alias("text"), "us",
        F.lit(skipped).cast("int").alias("skipped"),
    )
