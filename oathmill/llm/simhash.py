"""SimHash near duplicates by pigeonhole blocks.

Texts are lower-cased in A-Z and cut into words; a shingle is three words joined
by one space, repeats counted (a shorter text is one shingle; a text without
words, or null, has fingerprint 0 and links like any other). A fingerprint bit is
set if it is set in more than half of the shingles' XXH64 (seed 42). Two
fingerprints link at no more than MOST_BITS differing bits.

Work is on distinct fingerprints, so copies never meet. 64 bits make six blocks:
three differing bits leave three blocks or more untouched, so a close pair shares
the key of at least one of the 20 triples of blocks. A key with more than
HOT_KEY fingerprints is split by the same rule again over the bits it leaves
open; then at most 16 bits are free, whatever the input. Each pair is
emitted for its first shared key only. Components come from alternating large and
small stars on the links, repeated until every component is a star. Counts and smallest
neighbours are tables of their own before they are joined, so a frequent key or a hub
meets plain shuffles, which adaptive execution can split.

doc_id may repeat: rows with one doc_id and different texts are linked by their
texts as other rows are. A null doc_id never names a component unless it has no
other. Repeated rows get one component. Of equal bit counts (half the shingles) the bit
stays 0. A long text is cut whole, in memory of its own size. Extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, Stage, batched, text_bytes

SHINGLE, SEED, MOST_BITS, HOT_KEY = 3, 42, 3, 256
#: (first bit, bits) of the blocks: six of all 64 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(b" ".join(t), SEED) for t in zip(words, words[1:], words[2:], strict=False)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
        keys = {c: batch.column(c).cast(pa.int64()) for c in batch.schema.names if c != "text"}
        yield pa.RecordBatch.from_arrays([*keys.values(), pa.array(prints.view(np.int64))], [*keys, "fp"])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id and other whole-number ``keys``, fp (the 64 bits as a signed long)."""
    names = ("doc_id", *keys)
    return docs.select(*names, "text").mapInArrow(batched(_fingerprints), ", ".join(f"{c} long" for c in (*names, "fp")))


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    m = sum(((1 << n) - 1) << at for at, n in blocks)
    return m - (1 << 64) if m >= 1 << 63 else m


MASKS = tuple(_mask(c) for c in combinations(BLOCKS, len(BLOCKS) - MOST_BITS))


def _finer(mask: int) -> tuple[int, ...]:
    """Masks that split the bits ``mask`` leaves open by the same rule; each holds ``mask`` too."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [free[len(free) * i // 6 : len(free) * (i + 1) // 6] for i in range(6)]
    full = [sum(1 << b for part in c for b in part) | (mask & (2**64 - 1)) for c in combinations(cut, 3)]
    return tuple(m - (1 << 64) if m >= 1 << 63 else m for m in full)


FINER = tuple(_finer(m) for m in MASKS)


def _first_shared(a: Column, b: Column, masks: tuple[int, ...], k: Column) -> Column:
    """Whether mask number k is the first one under which a and b are equal."""
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(m).cast("long")) == 0, i).otherwise(first)
    return first == k


def _close(keys: DataFrame, on: list[str], masks: tuple[int, ...] | None) -> DataFrame:
    a, b = keys.alias("a"), keys.alias("b")
    meet = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MOST_BITS)
    for c in on:
        meet = meet & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    if masks:
        meet = meet & _first_shared(F.col("a.fp"), F.col("b.fp"), masks, F.col("a.k"))
    return a.join(b, meet).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(stage: Stage, nodes: DataFrame) -> DataFrame:
    """u < v: all pairs of distinct fingerprints (column fp) that differ in 1 to MOST_BITS bits."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(MASKS)])).alias("x")).select("fp", "x.k", "x.key")
    sizes = stage.write(keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = stage.write(keyed.join(sizes, ["k", "key"]), "keys")
    cold = _close(met.where(F.col("n") <= HOT_KEY), ["k", "key"], MASKS)
    finer = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in FINER])
    hot = met.where(F.col("n") > HOT_KEY).select("fp", "k", F.posexplode(F.get(finer, F.col("k"))).alias("k2", "m2"))
    hot = hot.select("fp", "k", "k2", F.col("fp").bitwiseAND(F.col("m2")).alias("key2"))
    return stage.write(cold.unionByName(_close(hot, ["k", "k2", "key2"], None)), "pairs").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node is below two others, or below one and above another: then every component is a star around its smallest node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under")))
    return ends.groupBy("node").agg(F.sum("over").alias("over"), F.max("under").alias("under")).where((F.col("over") + F.col("under") > 1) & (F.col("over") > 0)).isEmpty()


def components(stage: Stage, pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node that links reach, for every node of a pair (u, v)."""
    edges = stage.write(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges0")
    turn = 0
    while not _stars(edges):  # each turn lowers a node's parent
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"low{turn}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.write(large, f"large{turn}")
        low = stage.write(large.groupBy("u").agg(F.min("v").alias("m")), f"least{turn}")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage.write(small.distinct(), f"edges{turn}")
        for name in (f"edges{turn - 1}", f"low{turn}", f"large{turn}", f"least{turn}"):
            stage.drop(name)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())


def _rooted(stage: Stage, nodes: DataFrame) -> DataFrame:
    """The nodes (fp and a column first_id), each with the root of its component."""
    nodes = stage.write(nodes, "nodes")
    roots = stage.write(components(stage, links(stage, nodes.select("fp"))), "roots")
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    stage = Stage(spark, "simhash")
    prints = stage.write(fingerprints(docs), "prints")
    named = _rooted(stage, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = stage.write(named, "named")
    lowest = stage.write(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    names = stage.write(named.join(lowest, "root").select("fp", "component_id"), "names")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
