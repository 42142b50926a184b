"""Near-duplicate detection by MinHash with tensored banding.

A document's set holds its distinct 5-word shingles.  Instead of one collection
of minhashes a table, ``COLLECTIONS`` small collections of ``ROWS`` minhashes are
computed and every pair of collections keys one table: 16 collections of 2 give
120 tables of 4-hash keys from 32 minhashes.  A pair of documents with Jaccard
similarity 0.75 shares two collections, and so a table key, with probability
0.99996; the similarity of every candidate is then confirmed on full sets.

Skew
----
* Equal sets collapse to one representative before any banding.
* A collection value held by one representative only cannot be part of a shared
  key and is dropped before the keys are formed.
* A bucket never emits all its pairs: first each member is compared with the
  bucket's most central member only (a star), and the links found are closed to
  components.  Only stars whose members lie in several components are looked at
  again, all by one rule: members outside the star's largest component are compared
  with all others in blocks, on full sets, and a block emits only the links that join
  components.  So no link is lost to a cap, and no step emits the pairs of a large group.
* Joins by the centre of a star split large stars into parts (``split_join``); all
  else are joins and aggregations that Spark can split.

Defined results
---------------
* Words are runs of anything but space, tab, LF, VT, FF and CR, after A-Z are
  lower-cased.  With fewer than five words the whole sequence is one shingle.
  Null, empty and wordless texts have an empty set and are linked with nothing.
* Shingles are 64-bit hashes of their word sequence.
* Repeated rows get a row each.  Rows of one doc_id are one document: their links
  are joined.  A null id links through an equal set but is never a component's name,
  so its component is null if no document with an id has that set; callers that need
  more number such rows first (``common.numbered_ids``).
* Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import cut, give_back, table

SHINGLE_WORDS = 5
PERCENT = 75
COLLECTIONS, ROWS = 16, 2
#: A block of a star: rows at most, and bytes of the longest sets at most.
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20
BROADCAST_IDS = 1_000_000
#: A key of more rows than this, and than one in SPLIT_KEYS of all rows, is split in joins.
SPLIT_ROWS, SPLIT_KEYS = 512, 1000
#: Words whose hashes a task keeps; they go when the task ends, so that idle workers hold nothing.
CACHE_WORDS = 250_000
_MULTIPLIERS = np.random.default_rng(2).integers(1, 1 << 32, (2, COLLECTIONS * ROWS), dtype=np.uint64).astype(np.uint32)
_MULTIPLIERS[0] |= 1
_known_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    for word in set(words).difference(_known_words):
        _known_words[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(_known_words.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    if len(_known_words) > CACHE_WORDS:
        kept = dict(islice(_known_words.items(), CACHE_WORDS // 3))
        _known_words.clear()
        _known_words.update(kept)
    out = []
    for text in texts:
        hashes = _word_hashes((text or b"").lower().split())
        n = len(hashes)
        take = min(width, n)
        if not n:
            out.append(hashes)
            continue
        rolled = np.full(n - take + 1, take, np.uint64)
        for k in range(take):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - take + 1 + k]
        out.append(np.unique(_mixed(rolled)))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(set, function) minhashes of non-empty sets."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((COLLECTIONS * ROWS, len(sets)), np.uint32)
    for n in range(COLLECTIONS * ROWS):
        out[n] = np.minimum.reduceat(values * _MULTIPLIERS[0, n] + _MULTIPLIERS[1, n], first)
    return out.T


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set identity and collection values of every row; the last null for empty sets."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist())
                full = [n for n, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                ids = np.zeros((2, len(sets)), np.int64)
                for n in full:
                    ids[0, n] = sets[n].sum(dtype=np.uint64).view(np.int64)
                    ids[1, n] = np.uint64(xxhash.xxh3_64_intdigest(sets[n].tobytes())).view(np.int64)
                if full:
                    pairs = minhashes([sets[n] for n in full]).astype(np.uint64).reshape(len(full), COLLECTIONS, ROWS)
                    keys = pairs[:, :, 0]
                    for k in range(1, ROWS):
                        keys = _mixed(keys) + pairs[:, :, k]
                    keys = _mixed(keys + np.arange(COLLECTIONS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    for row, n in enumerate(full):
                        bands[n] = keys[row].tolist()
                columns = (
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[0]), pa.array(ids[1]), pa.array(bands, pa.list_(pa.int64())),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in SIGNATURE_SCHEMA.split(", ")])
        _known_words.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(made, SIGNATURE_SCHEMA)


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, rep, n, score) of every table key that may be shared; ``reps`` has rep, n_shingles and bands.

    The score tells how common a representative's collection values are: the
    centre of a group of near copies has the commonest.
    """
    values = reps.select("rep", "n_shingles", F.posexplode("bands").alias("nth", "value"))
    shared = values.groupBy("nth", "value").agg(F.count("*").alias("n")).where("n > 1")
    held = (
        values.join(shared, ["nth", "value"])
        .groupBy("rep", "n_shingles")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("held"), F.sum("n").alias("score"))
        .where(F.size("held") > 1)
    )
    left = held.select("rep", F.col("n_shingles").alias("n"), "score", "held", F.posexplode("held").alias("at", "x"))
    pairs = F.transform(
        F.slice("held", F.col("at") + 2, F.size("held")),
        lambda y: F.xxhash64(F.col("x.nth"), F.col("x.value"), y["nth"], y["value"]),
    )
    return left.select("rep", "n", "score", F.explode(pairs).alias("key"))


def split_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` (read several times: cut it first) with ``few`` on ``key``; hot keys of ``rows`` meet in parts.

    A key with more rows than ``SPLIT_ROWS``, and than one in ``SPLIT_KEYS`` of all, is hot: there are
    no more than ``SPLIT_KEYS`` of them, so their list is broadcast, and what ``few`` holds of them
    is repeated once a part.
    """
    most = max(SPLIT_ROWS, -(-rows.count() // SPLIT_KEYS))
    hot = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = cut(hot.select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    if hot.isEmpty():
        return rows.join(few, key)
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("__parts")
    right = few.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def candidate_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents ``ids`` (doc_id): their full sets as sorted 64-bit values."""
    # the ids of candidates are broadcast only while they are few; beyond that both sides are shuffled
    ids = cut(ids)
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["doc_id", "shingles"])
        _known_words.clear()
        give_back()

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
        .join(wanted, "doc_id")
        .mapInArrow(sets, "doc_id long, shingles binary")
    )


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (doc_id, shingles) are similar enough; one ``a`` may have very many ``b``.

    Rows of one id may have several sets; each is compared.
    """
    a = full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same * 100 >= PERCENT * (len(both) - same) and same > 0)
            yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(keep, pa.bool_())) for n in (0, 1)], names=["a", "b"])

    return split_join(pairs, a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots: alternating large and small stars until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_across(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between components in one block of a star, as pairs of roots: exact, and no more than it takes to join them.

    One pass over the block's shingles counts the intersections of a minor member with
    all others, so a block costs (minor members) x (shingles) and emits a forest.
    """
    minor, others = frame[frame["is_minor"]], frame[~frame["is_minor"]]
    out: list[tuple[int, int]] = []
    if len(minor) and len(others):
        sets = [np.frombuffer(x, np.uint64) for x in others["shingles"]]
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        first = np.cumsum(sizes) - sizes
        roots = others["root"].to_numpy()
        joined: dict[int, int] = {}

        def top(root: int) -> int:
            while joined.get(root, root) != root:
                root = joined[root]
            return root

        for root, shingles in zip(minor["root"], minor["shingles"], strict=True):
            own = np.frombuffer(shingles, np.uint64)
            held = np.zeros(len(values), np.int64)
            at = np.searchsorted(values, own)
            inside = at < len(values)
            held[at[inside][values[at[inside]] == own[inside]]] = 1
            same = np.add.reduceat(held[place], first)
            near = np.flatnonzero((same * 100 >= PERCENT * (sizes + len(own) - same)) & (roots != root))
            for other in np.unique(roots[near]).tolist():
                x, y = top(int(root)), top(other)
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    out.append((min(x, y), max(x, y)))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def across(star: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame:
    """Links between components that meet in a star, as pairs (a, b) of their roots.

    ``star`` has (a, b, nb): centre, member and the member's set size.  Centres have been compared with
    all their members, so what is left are pairs of members.  Buckets with the same centre
    are one star, so a pair that meets in many tables is looked at once.
    """
    members = star.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("nb").alias("n"))
    labelled = cut(members.join(roots, F.col("rep") == F.col("node"), "left").select("hub", "rep", "n", F.coalesce("root", "rep").alias("root")))
    by_root = labelled.groupBy("hub", "root").agg(F.count("*").alias("m"), F.max("n").alias("longest"))
    shape = (
        by_root.groupBy("hub")
        .agg(F.max(F.struct("m", "root")).alias("x"), F.sum("m").alias("all"), F.count("*").alias("roots"), F.max("longest").alias("longest"))
        .where("roots > 1")
        .withColumn("size", F.greatest(F.lit(4), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / 8 / F.col("longest")))))
        .select(
            "hub", F.col("x.root").alias("major"), F.ceil(F.col("all") / F.col("size")).cast("int").alias("blocks"),
            F.ceil((F.col("all") - F.col("x.m")) / F.col("size")).cast("int").alias("minor_blocks"),
        )
    )
    rows = cut(split_join(labelled, cut(shape), "hub").select("hub", "rep", "root", "blocks", "minor_blocks", (F.col("root") != F.col("major")).alias("minor")))
    # a block holds about "size" minor members and "size" others; both sides of a pair meet in one block, and
    # minor members also stand among the others, so that two of them meet
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_other = rows.select("hub", "rep", "root", own(F.col("blocks")).alias("ob"), each("minor_blocks").alias("mb"), F.lit(False).alias("is_minor"))
    as_minor = rows.where("minor").select("hub", "rep", "root", each("blocks").alias("ob"), own(F.col("minor_blocks")).alias("mb"), F.lit(True).alias("is_minor"))
    placed = as_other.unionByName(as_minor).join(full.withColumnRenamed("doc_id", "rep"), "rep")
    found = placed.select("hub", "mb", "ob", "root", "is_minor", "shingles").groupBy("hub", "mb", "ob").applyInPandas(linked_across, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    rows = cut(signatures(docs))
    full = rows.where("n_shingles > 0")
    identity = ["n_shingles", "set_a", "set_b"]
    classes = cut(full.groupBy(identity).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    reps = classes.where("rep is not null")

    keys = cut(table_keys(reps.select("rep", "n_shingles", "bands")).distinct())
    hubs = keys.groupBy("key").agg(F.max(F.struct("score", "rep", "n")).alias("hub"), F.count("*").alias("held")).where("held > 1")
    pairs = keys.join(hubs, "key").where("hub.rep <> rep").select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    star = cut(pairs.distinct())
    full_sets = cut(candidate_sets(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs))
    # sets whose sizes differ too much cannot be linked
    possible = star.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    links = confirmed(possible, full_sets)

    # rows of one id with several sets are one node
    mixed = full.groupBy("doc_id").agg(F.min(F.struct(*identity)).alias("x"), F.max(F.struct(*identity)).alias("y"))
    mixed = cut(mixed.where("doc_id is not null and x <> y").select("doc_id"))
    if not mixed.isEmpty():
        own = full.join(mixed, "doc_id").join(reps.select(*identity, "rep"), identity)
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    roots = components(links)
    joined = components(across(star, roots, full_sets))
    top = joined.select(F.col("node").alias("low"), F.col("root").alias("top"))
    named = (
        classes.select(*identity, "rep")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .withColumn("low", F.coalesce("root", "rep"))
        .join(top, "low", "left")
        .select(*identity, F.coalesce("top", "low").alias("component_id"))
    )
    linked = full.select("doc_id", *identity).join(named, identity).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * same >= 75 * (x.n + y.n - same)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
