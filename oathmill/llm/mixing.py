"""Mixing sources to target weights by pivotal dependent rounding.

Sizes are words. Every source gets a target share of all words; a document of a
source with target t and size total s is wanted t / s times. The whole part is
taken for sure; the fractions are rounded by the pivotal method: two units hand
words from one to the other, at random and without bias, until one of them is
whole. Their sum of words never changes, so a source misses its target by less
than its one last unit. Documents are dealt into hash buckets; each bucket rounds
its own units and hands on one residual per source, and the residuals meet in a
reduction tree of fixed fan-in, so no task sees a whole source.

Rows that are equal in doc_id, source and size are pivoted with each other first, in
one step: of m equal fractions p, floor(m p) are whole and one residual is left.

All randomness comes from hashes of (doc_id, source, size, seed): reruns and other
partitionings agree. Targets are found by rounds of aggregates over the table of sources;
only sums reach the driver. Null and empty texts have size 0 and are taken 0 times. Null
sources are a source of their own, last. A null doc_id is an id like others. Of equal rows
any may be the ones taken once more. A long text counts by its words. Extra columns stay out
of the result. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, Stage, batched, repeated, sized_broadcast

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = 20_240_817
#: Units in a bucket on average, and residuals that one node of the tree joins.
BUCKET_UNITS, FAN_IN = 512, 256
EPS = 1e-9


def numbered(stage: Stage, names: DataFrame) -> DataFrame:
    """``names`` (distinct) with their rank in code point order, null last, from 0; ranges are numbered apart, and their counts added."""
    ranged = names.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    ranged = stage.write(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    counts = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row per range
    before, total = [F.lit(0)], 0  # at least one entry
    for k in range(max(counts, default=-1) + 1):
        before[k:] = [F.lit(total).cast("long")]
        total += counts.get(k, 0)
    return ranged.withColumn("rank", F.get(F.array(*before), part.cast("int")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def targets(stage: Stage, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: the sum of sizes shared by weight; no source above ``most`` times its size, the excess reshared by weight."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    rows = stage.write(numbered(stage, sizes).select("source", "source_size", weight.cast("long").alias("weight"), (most * F.col("source_size")).alias("most")), "weighed")
    whole = rows.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    unit, full = 0.0, -1
    while True:  # whole numbers are summed, so the order of rows does not matter; the full sources only grow
        over = F.col("weight") * F.lit(unit) > F.col("most")
        found = rows.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if found["n"] == full or not found["weight"]:
            break
        full, unit = found["n"], (whole - found["taken"]) / found["weight"]
    return rows.select("source", "source_size", F.least(F.col("weight") * F.lit(unit), F.col("most").cast("double")).alias("target"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(unit: int, level: int) -> float:
    return float(_mix(np.array([unit & (2**64 - 1)], dtype=np.uint64) ^ np.uint64(SEED + 7919 * level))[0]) / 2.0**64


def pivot(units: list[tuple[int, float, int]], level: int) -> tuple[list[tuple[int, int]], tuple[int, float, int] | None]:
    """units: (key, probability, words), in order. Gives (key, 0 or 1) for those that became whole, and the one that did not."""
    done: list[tuple[int, int]] = []
    held: tuple[int, float, int] | None = None
    for unit in units:
        if unit[1] <= EPS or unit[1] >= 1 - EPS:
            done.append((unit[0], int(unit[1] > 0.5)))
            continue
        if held is None:
            held = unit
            continue
        (ka, pa_, wa), (kb, pb, wb) = held, unit
        up = min((1 - pa_) * wa, pb * wb)  # words from b to a
        down = min(pa_ * wa, (1 - pb) * wb)  # words from a to b
        if uniform(ka ^ (kb * 0x9E3779B97F4A7C15), level) * (up + down) < down:
            pa_, pb = pa_ + up / wa, pb - up / wb
        else:
            pa_, pb = pa_ - down / wa, pb + down / wb
        held = None
        for k, p, w in ((ka, pa_, wa), (kb, pb, wb)):
            if p <= EPS or p >= 1 - EPS:
                done.append((k, int(p > 0.5)))
            else:
                held = (k, p, w)
    return done, held


_UNIT = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("words", pa.int64()), ("key", pa.int64()), ("p", pa.float64()), ("bucket", pa.int64()), ("up", pa.int32())])


def _round(level: int, last: bool):
    """Pivots each run of one (bucket, source) in a sorted partition; ``up`` is null for a residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, units = None, {}

        def close() -> None:
            if at is None:
                return
            done, held = pivot([(k, u[3], u[1]) for k, u in units.items()], level)
            if held and last:
                done.append((held[0], int(uniform(held[0], 99) < held[1])))
                held = None
            out.extend((at[1], *units[k][:3], None, at[0], up) for k, up in done)
            if held:
                out.append((at[1], *units[held[0]][:3], held[1], at[0], None))

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_UNIT), _UNIT, strict=True)], schema=_UNIT)
            out.clear()
            return made

        for batch in batches:
            for source, doc_id, words, key, p, bucket in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (bucket, source) != at:
                    close()
                    at, units = (bucket, source), {}
                name = key
                while name in units:  # two units with one hash
                    name += 1
                units[name] = (doc_id, words, key, p)
            if len(out) > 20_000:
                yield rows()
        close()
        yield rows()

    return run


def _level(units: DataFrame, level: int, last: bool) -> DataFrame:
    dealt = units.repartition("bucket", "source").sortWithinPartitions("bucket", "source", F.xxhash64("key", F.lit(level)), "key", "doc_id", "words")
    return dealt.select("source", "doc_id", "words", "key", "p", "bucket").mapInArrow(batched(_round(level, last), 10_000), "source string, doc_id long, words long, key long, p double, bucket long, up int")


def mixed_groups(spark: SparkSession, docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, key, twins (equal rows), copies (of each), more (how many of the twins are taken once more).

    With a column ``row``, which tells rows of one doc_id, source and size apart, the group's ``more`` go to the smallest ``row`` first.
    """
    apart = [row] if row else []
    stage = Stage(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    twins = stage.write(docs.select("doc_id", "source", size.alias("size"), *apart).groupBy("doc_id", "source", "size", *apart).agg(F.count("*").alias("twins")), "twins")
    shares = stage.write(targets(stage, twins.groupBy("source").agg(F.sum(F.col("size") * F.col("twins")).alias("source_size"))), "shares")
    shares = shares.select(F.col("source").alias("name"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    groups = twins.groupBy("doc_id", "source", "size").agg(F.sum("twins").alias("twins")) if row else twins
    groups = groups.join(sized_broadcast(shares), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    part = F.col("rate") - F.floor("rate")
    sure = F.floor(F.col("twins") * part + F.lit(EPS))
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull(), "size", F.lit(SEED))
    groups = stage.write(groups.select("doc_id", "source", "size", "source_size", "target", "twins", F.floor("rate").cast("int").alias("copies"), sure.alias("sure"), (F.col("twins") * part - sure).alias("p"), key.alias("key")), "groups")
    buckets = max(1, ceil(groups.count() / BUCKET_UNITS))
    units = groups.where((F.col("size") > 0) & (F.col("p") > EPS)).select("source", "doc_id", F.col("size").alias("words"), "key", "p", F.pmod("key", F.lit(buckets)).alias("bucket"))
    levels = 1 + max(0, ceil(log(buckets, FAN_IN) - 1e-9)) if buckets > 1 else 1
    decided = None
    for level in range(levels):
        done = stage.write(_level(units, level, level == levels - 1), f"level{level}")
        whole = done.where("up = 1").select(*[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "words")], "up")
        decided = whole if decided is None else decided.unionByName(whole)
        units = done.where("up is null").select("source", "doc_id", "words", "key", "p", F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"))
    # by all that makes the unit: a hash alone could meet another
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_words"))
    taken = F.col("size") > 0
    out = groups.join(decided, same, "left").withColumns({"copies": F.when(taken, F.col("copies")).otherwise(0), "more": F.when(taken, F.col("sure") + F.coalesce("up", F.lit(0))).otherwise(0)})
    out = out.select("doc_id", "source", "size", "source_size", "target", "key", "twins", "copies", "more")
    if not row:
        return out
    earlier = Window.partitionBy("doc_id", "source", "size").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    rows = twins.withColumn("before", F.coalesce(F.sum("twins").over(earlier), F.lit(0))).withColumnsRenamed({"doc_id": "_doc_id", "source": "_source", "size": "_words"})
    return out.drop("twins").join(rows, same).withColumn("more", F.least(F.greatest(F.col("more") - F.col("before"), F.lit(0)), F.col("twins"))).drop("before", "_doc_id", "_source", "_words")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes it), taken (words), key: a row per row."""
    rows = repeated(mixed_groups(spark, docs), F.col("twins"), "number")
    out = rows.withColumn("copies", F.col("copies") + (F.col("number") < F.col("more")).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")
