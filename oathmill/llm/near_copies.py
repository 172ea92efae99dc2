"""Near copies by two pigeonhole rules: op7's fingerprint blocks, and blocks of a longer fingerprint for Jaccard 0.8.

64 SimHash bits cannot hold texts at a similarity of 0.8: such pairs differ in about nine bits. So, beside
op7's links (three-word shingles, three bits), texts link whose sets of five-word shingles (A-Z lower-cased; a shorter text
is one shingle) have a Jaccard similarity of SIMILAR or more. Their fingerprint is BLOCKS * WIDTH least hashes, split into
BLOCKS blocks, as op7 splits its bits: pairs that differ in fewer than BLOCKS of them must share a block, and a pair at
similarity s misses with probability (1 - s^WIDTH)^BLOCKS, 0.0014 at 0.8. Texts that share a block are verified on whole shingle sets.

Work is on distinct sets, so copies never meet. The sets that share a block are written once, and shingles that only one of
them has are counted: two sets have no more in common than the smaller count of the rest, which tells many pairs apart
unseen (copies of one text with edits of their own, a common form with texts of their own). First every set meets one other,
the one of its blocks with the smallest share of such shingles. What is linked by then needs no further proof; next only sets of one block that lie in
different components, and that may still be SIMILAR by the counts, meet. Sets of blocks with more than HOT_KEY sets
meet, whatever their blocks, by one of their rarest shingles, as sets at SIMILAR must, if what follows it in both is still enough.
Components are op7's stars.

A row is known by its doc_id, which may be null or repeat, and a number ``row``. Null texts and texts without a word have
no shingle and link by op7's rule alone. A long text is cut whole, in memory of its own size. Extra columns are left out, repeated
rows are one, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .shared import LOWER, Stage, batched, text_bytes

SHINGLE, SIMILAR, BLOCKS, WIDTH, HOT_KEY = 5, 0.8, 28, 7, 256
#: Shingles hashed at a time.
CHUNK = 2048
_ODD = np.random.default_rng(7).integers(0, 2**63, (2, BLOCKS * WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the text's five-word shingles, ascending."""
    words = text.translate(LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    if not size:
        return hashes
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = _mixed(total * _STEP + hashes[i : i + n])
    return np.unique(total)


def block_keys(found: np.ndarray) -> np.ndarray:
    """One key for each block of least hashes; two blocks of different numbers have different keys."""
    least = np.full(BLOCKS * WIDTH, 2**64 - 1, np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[i : i + CHUNK, None] ^ _ODD[0]) * _ODD[1]).min(axis=0))
    key = np.arange(1, BLOCKS + 1, dtype=np.uint64)
    for column in least.reshape(BLOCKS, WIDTH).T:
        key = _mixed(key * _STEP + column)
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, sizes, keys, prints = [], [], [], []
        for text in text_bytes(batch.column("text")):
            found = shingles(text)
            with np.errstate(over="ignore"):
                sets.append(int(_mixed(found * _STEP).sum(dtype=np.uint64).astype(np.int64)) if len(found) else 0)
            sizes.append(len(found))
            keys.append(block_keys(found) if len(found) else np.empty(0, np.int64))
            prints.append(simhash.fingerprint(text))
        rest = [batch.column(c).cast(pa.int64()) for c in ("doc_id", "row")]
        prints = np.array(prints, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "s", "size", "fp", "keys"])


def sketches(rows: DataFrame) -> DataFrame:
    """doc_id, row, s (a hash of the shingle set), size (its shingles), fp (op7's fingerprint), keys (one for each block)."""
    return rows.select("doc_id", "row", "text").mapInArrow(batched(_sketches), "doc_id long, row long, s long, size long, fp long, keys array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text).view(np.int64) for text in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(found, pa.list_(pa.int64()))], ["s", "found"])


def shingle_sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, found (the shingles) of the sets ``wanted`` (column s); only their texts are read again."""
    named = nodes.join(wanted, "s", "left_semi").select("s", F.col("first_id.nameless").alias("nameless"), F.coalesce("first_id.doc_id", F.lit(0).cast("long")).alias("id"), F.col("first_id.row").alias("row"))
    texts = rows.select(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "row", "text")
    # rows of one doc_id and one number are equal: one is enough
    once = texts.join(named, ["nameless", "id", "row"]).groupBy("s").agg(F.first("text").alias("text"))
    return once.mapInArrow(batched(_sets, 64), "s long, found array<long>")


def common_shingles(sets: DataFrame) -> DataFrame:
    """s, size, common: how many shingles a set has, and how many of them another of the sets has too."""
    alone = sets.select("s", F.explode("found").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.first("s").alias("s")).where("n = 1").groupBy("s").agg(F.count("*").alias("alone"))
    return sets.select("s", F.size("found").alias("size")).join(alone, "s", "left").select("s", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def verified(sets: DataFrame, similar: float, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v of column s) whose shingle sets have a Jaccard similarity of ``similar`` or more."""
    both = pairs.join(sets.select(F.col("s").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("s").alias("v"), F.col("found").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= F.lit(similar) * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _across(members: DataFrame, on: str) -> DataFrame:
    """Pairs equal in column ``on``, in different components, that may be SIMILAR by their counts. Where members have a place ``at`` of the
    value in their order of shingles, a pair meets at its first common one alone or after it: no more than what follows is common."""
    a, b = members.alias("a"), members.alias("b")
    most = F.least("a.common", "b.common")
    if "at" in members.columns:
        most = F.least(most, F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    meet = (F.col("a.s") < F.col("b.s")) & (F.col("a.root") != F.col("b.root")) & (F.col(f"a.{on}") == F.col(f"b.{on}"))
    meet = meet & (most >= F.lit(SIMILAR) * (F.col("a.size") + F.col("b.size") - most))
    return a.join(b, meet).select(F.col("a.s").alias("u"), F.col("b.s").alias("v"))


def prefixes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """s, x, at: the rarest shingles of each wanted set (column s), one more than it may lack in a set at SIMILAR, and their places in that
    order from 0. Two such sets have one of these in common, whatever the order, so those that meet by them are all. Shingles of one
    set alone count, but meet nothing."""
    held = sets.join(wanted.select("s"), "s", "left_semi").select("s", F.explode("found").alias("x"))
    counts = held.groupBy("x").agg(F.count("*").alias("n"))
    ordered = held.join(counts, "x").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    most = (F.size("o") - F.ceil(F.lit(SIMILAR) * F.size("o") - 1e-9) + 1).cast("int")
    return ordered.select("s", F.posexplode(F.slice("o", F.lit(1), most)).alias("at", "o")).where("o.n > 1").select("s", "o.x", "at")


def _same_print(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """op7's links between sets: those of one fingerprint with its least set, and the least sets of near fingerprints."""
    stage = Stage(spark, "simhash")
    least = stage.write(prints.groupBy("fp").agg(F.min("s").alias("low")), "least")
    near = simhash.links(stage, least.select("fp"))
    u, v = (least.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in "uv")
    near = near.join(u, "u").join(v, "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
    return prints.select("s", "fp").distinct().join(least, "fp").select(F.col("s").alias("u"), F.col("low").alias("v")).unionByName(near)


def rooted(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """s, first_id (the first row of the set: nameless, doc_id, row) and root, one for each component."""
    stage = Stage(spark, "nearcopies")
    prints = stage.write(sketches(rows), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = stage.write(prints.groupBy("s").agg(F.min(first).alias("first_id"), F.first("keys").alias("keys")), "nodes")
    keyed = nodes.select("s", F.explode("keys").alias("key"))
    met = stage.write(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key"), "met")
    sets = stage.write(shingle_sets(rows, nodes, met), "sets")
    counts = common_shingles(sets).where(F.col("common") >= F.lit(SIMILAR) * F.col("size"))
    met = stage.write(met.join(stage.write(counts, "counts"), "s"), "may")

    linked = stage.write(_same_print(spark, prints), "same_print")
    centres = met.groupBy("key").agg(F.min(F.struct((F.lit(1) - F.col("common") / F.col("size")).alias("alone"), "s")).alias("centre"))
    stars = met.join(centres, "key").groupBy("s").agg(F.min("centre").alias("c")).where("s <> c.s").select(F.col("s").alias("u"), F.col("c.s").alias("v"))
    linked = linked.unionByName(stage.write(verified(sets, SIMILAR, stage.write(stars, "stars")), "linked"))

    roots = stage.write(simhash.components(Stage(spark, "simhash"), linked), "roots").select(F.col("node").alias("s"), "root")
    members = stage.write(met.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "members")
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    several = stage.write(members.join(several, "key"), "several")
    # a set meets by its own rarest shingles, once each, however many hot blocks it is in
    hot = stage.write(several.where(F.col("members") > HOT_KEY).groupBy("s").agg(*[F.first(c).alias(c) for c in ("size", "common", "root")]), "hot")
    held = stage.write(prefixes(sets, hot).join(hot, "s"), "prefixes")
    mixed = held.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("x")
    pairs = _across(several.where(F.col("members") <= HOT_KEY), "key").unionByName(_across(held.join(mixed, "x"), "x"))
    pairs = stage.write(stage.write(pairs, "across").distinct(), "pairs")
    linked = roots.where("s <> root").select(F.col("s").alias("u"), F.col("root").alias("v")).unionByName(stage.write(verified(sets, SIMILAR, pairs), "linked2"))

    roots = stage.write(simhash.components(Stage(spark, "simhash"), linked), "roots2").select(F.col("node").alias("s"), "root")
    return nodes.join(roots, "s", "left").select("s", "first_id", F.coalesce("root", "s").alias("root"))


def representatives(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """doc_id, row: of each component the row with the smallest doc_id (a null one last), then the smallest ``row``."""
    named = rooted(spark, rows).groupBy("root").agg(F.min("first_id").alias("r"))
    return Stage(spark, "nearcopies").write(named.select("r.doc_id", "r.row"), "first")
