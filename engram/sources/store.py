"""Whole-store export and import, and guards on what is read."""


import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from engram.lineage import cut

FORMAT = 1


def export_store(tables: dict[str, DataFrame], path: str, vectors: bool = True, vector_columns: tuple[str, ...] = ("embedding",), model: str | None = None) -> DataFrame:
    """Write each table as JSON lines and a manifest (table, n, format, model, width); returns the manifest.

    ``model`` names what made the vectors; ``width`` is theirs, null for a table without any.
    """
    manifest = None
    for name, df in tables.items():
        kept = df if vectors else df.drop(*vector_columns)
        kept.write.mode("errorifexists").json(f"{path}/{name}")
        wide = [F.max(F.size(c)) for c in vector_columns if c in kept.columns]
        width = (F.greatest(*wide) if len(wide) > 1 else wide[0]) if wide else F.lit(None)
        line = kept.agg(F.count("*").alias("n"), width.cast("int").alias("width")).select(F.lit(name).alias("table"), "n", F.lit(FORMAT).alias("format"), F.lit(model).cast("string").alias("model"), "width")
        manifest = line if manifest is None else manifest.unionByName(line)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


MANIFEST = "table string, n long, format int, model string, width int"


def import_store(
    spark: SparkSession, path: str, schemas: dict, existing: dict[str, tuple[DataFrame, str]] | None = None, model: str | None = None, width: int | None = None,
    reembed: bool = False, vector_columns: tuple[str, ...] = ("embedding",),
) -> dict[str, DataFrame]:
    """Tables of an export; another format is refused.  Where a table exists already, (frame, key), only new keys are added.

    With ``model`` or ``width``, vectors of another are refused, or, with ``reembed``, left null: rows without a vector are those to embed.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    if manifest.where(~F.col("format").eqNullSafe(F.lit(FORMAT))).limit(1).count():
        raise ValueError("this store was written in another format")
    foreign = F.lit(False)
    if model is not None:
        foreign = foreign | (F.col("model") != model)
    if width is not None:
        foreign = foreign | (F.col("width") != width)
    foreign = {r["table"] for r in manifest.where(F.col("width").isNotNull() & foreign).select("table").collect()}  # one row a table
    if foreign and not reembed:
        raise ValueError(f"vectors of another model or width: {', '.join(sorted(foreign))}")
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        if name in foreign:
            df = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in vector_columns if c in df.columns})
        if existing and name in existing:
            old, key = existing[name]
            df = old.unionByName(df.join(old.select(key), key, "left_anti").select(old.columns))
        out[name] = df
    return out


def in_two_passes(rows: DataFrame, key: str, parent: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to insert with no parent, (key, parent) to set afterwards): a self-referring table loads in any order of its rows.

    A parent that is neither among the rows nor in ``known`` (key) is not set.
    """
    there = rows.select(F.col(key).alias(parent))
    if known is not None:
        there = there.unionByName(known.select(F.col(key).alias(parent)))
    links = rows.where(F.col(parent).isNotNull()).select(key, parent).join(there.distinct(), parent, "left_semi").select(key, parent)
    return rows.withColumn(parent, F.lit(None).cast(rows.schema[parent].dataType)), links


def load_order(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth): how many rows must be there before each one; null for rows on a circle of parents, or below one.

    Every round doubles the way that a row looks up, so a chain of any length takes as many rounds as its length
    has binary digits.  A parent that is not there ends a way.
    """
    links = in_two_passes(rows.select(key, parent), key, parent)[1].withColumnRenamed(parent, "up")
    state = cut(rows.select(key).join(links, key, "left").select(F.col(key).alias("id"), "up", F.col("up").isNotNull().cast("long").alias("depth")))
    most = state.count()
    while most and state.where("up is not null").limit(1).count():
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = cut(state.join(ahead, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if state.agg(F.max("depth")).first()[0] > 2 * most:  # only a circle makes a way longer than all rows
            break
    return state.select(F.col("id").alias(key), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def backup(tables: dict[str, DataFrame], folder: str, stamp: str, keep: int = 7) -> list[str]:
    """Export all tables below ``folder``/``stamp`` and delete the oldest backups beyond ``keep``; returns the stamps that stay.

    Stamps sort by time; an export without its manifest did not end, and does not count.
    """
    spark = next(iter(tables.values())).sparkSession
    export_store(tables, f"{folder}/{stamp}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = sorted(s.getPath().getName() for s in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{s.getPath().getName()}/manifest/_SUCCESS")))
    for old in whole[:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
    return whole[-keep:]


def check_vectors(df: DataFrame, column: str, width: int) -> DataFrame:
    """``df``, refused if any vector has another width; the check reads the column's sizes only."""
    bad = df.where(F.col(column).isNotNull() & (F.size(column) != width)).limit(1).count()
    if bad:
        raise ValueError(f"{column} holds vectors that are not {width} wide")
    return df


def new_documents(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose content hash is not registered yet."""
    return found.withColumn("sha256", F.sha2(F.col("text"), 256)).join(registry.select("sha256"), "sha256", "left_anti")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML decoded, named and numbered; the no-break space becomes a space.  Arrow-batched: the table of names is Python's."""
    return text.map(lambda t: None if t is None else unescape(t).replace("\xa0", " "))


def page_lines(html: str = "html"):
    """Text of a page by lines, as a column: scripts, styles and tags dropped, blank lines stripped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?(</\1\s*>|$)", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?(-->|$)", "\n"), r"(?s)<[^>]*(>|$)", "\n")
    lines = F.transform(F.split(unescaped(bare), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_title(html: str = "html"):
    """The title element, decoded; without one the first heading's text."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    heading = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), r"(?s)<[^>]*>", ""))
    return unescaped(F.when(title != "", title).otherwise(heading))


def file_kind(path: str = "path"):
    """Parser family of a file name; null for formats that are refused."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kinds = {"text": ("txt", "md", "rst", "log"), "html": ("html", "htm"), "table": ("csv", "tsv"), "document": ("docx", "pptx"), "sheet": ("xlsx",), "source": ("py", "js", "ts", "java", "go", "rs", "c", "cpp"), "json": ("json", "jsonl")}
    out = F.lit(None).cast("string")
    for kind, exts in kinds.items():
        out = F.when(ext.isin(*exts), F.lit(kind)).otherwise(out)
    return out


def sniff_delimiter(head: str) -> str:
    """The commonest of , ; tab | in the first lines of a table."""
    lines = [line for line in re.split(r"\r?\n", head[:8192]) if line][:20]
    counts = {d: min((line.count(d) for line in lines), default=0) for d in ",;\t|"}
    return max(counts, key=lambda d: (counts[d], -",;\t|".index(d)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file with its sniffed delimiter; only the head is looked at on the driver."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
    sep = "\t" if path.endswith(".tsv") else sniff_delimiter(head)
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep)
