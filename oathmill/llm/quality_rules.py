"""Quality rules with adaptive cutoffs.

Base counts come from whole texts (null: no words). Beyond the base rules a document
goes if one of its ratios lies over its fence. Fences have no constants of their own:
they come from mergeable quantile sketches per (language, source), histograms of
whole numbers over buckets of fixed relative width, which merge by adding counts, so
that the result does not depend on partitions or order.

A sketch gives a middle (the median) and a spread (median less lower quartile, at
least 1): junk raises ratios, so the lower half of a group is what junk in less than
half of the documents leaves alone. Both are shrunk with the weight of SHRINK
documents towards those of the language, and these towards those of all documents, so
small groups lean on their language at no fixed size. The fence is the middle and
FENCE spreads, where a spread counts as twice the language's at most. A source whose
middle lies over the fence of its language is judged by the language's fence.

Ratios, in thousandths and rounded down: ASCII punctuation and symbols among the
characters of words (marks), characters per word (word_length), capitals among ASCII
letters (capitals).

Null languages and sources are groups like others. A null doc_id is kept as it is and
changes nothing. Repeated rows are judged one by one, each with the same verdict. A
ratio equal to its fence is within it. An empty text has no words and fails the base
rules. A long text is measured whole in memory of its own size. Extra columns are left
out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Stage, batched, code_points, sized_broadcast, text_bytes

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MOST_REPEAT_PERCENT = 8, 20, 30
FENCE, SHRINK = 12, 200
#: Ratios in thousandths.
RATIOS = ("marks", "word_length", "capitals")
#: Buckets for each power of two.
GRAIN = 1024
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _exact_ranks(words: list[bytes]) -> np.ndarray:
    """An id per 8-word window, equal only for equal windows."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        both = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(both, return_inverse=True)[1].reshape(-1)
        step *= 2
    return ids


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of 8 that the text has twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
    if len(np.unique(w)) == n:
        return 0
    ids = _exact_ranks(words)
    again = np.bincount(ids)[ids] > 1
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, np.flatnonzero(again), 1)
    np.add.at(marks, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _less(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the RATIOS."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.translate(None, ASCII_SPACE)]
    n, chars = len(words), code_points(text) - _less(text, ASCII_SPACE)
    dups, letters = len(lines) - len(set(lines)), _less(text, _LETTERS)
    ratios = (_less(text, MARKS), chars), (chars, n), (_less(text, _UPPER), letters)
    return n, chars, _less(text, SYMBOLS), dups, repeat_words(words), *(1000 * x // max(1, of) for x, of in ratios)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


CARRIED = {"text": pa.string(), "n_chars": pa.int64()}


def _measured(carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in text_bytes(batch.column("text"))]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS) + len(RATIOS))]
            cols += [batch.column(c).cast(CARRIED[c]) for c in carry]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), batch.column("source").cast(pa.string()), *cols], ["doc_id", "lang", "source", *COUNTS, *RATIOS, *carry])

    return run


def bucket(v: Column) -> Column:
    """Whole numbers under 2 * GRAIN as they are; above, GRAIN buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - GRAIN.bit_length(), F.lit(0))
    return F.when(v < 2 * GRAIN, v).otherwise(shift * GRAIN + F.call_function("shiftright", v, shift)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest whole number of a bucket."""
    shift = F.greatest(F.floor((b - GRAIN) / GRAIN), F.lit(0)).cast("int")
    return F.when(b < 2 * GRAIN, b.cast("long")).otherwise(F.call_function("shiftleft", (b - shift * GRAIN + 1).cast("long"), shift) - 1)


def _quantiles(cells: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """keys, metric -> n, mid, spread (with ``mark`` after their names), from cells (keys, metric, bucket, n)."""
    merged = cells.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    # a sketch has at most GRAIN buckets for each of 64 powers of two
    group = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sketch"), F.sum("n").alias("total"))

    def at(q: int) -> Column:  # first bucket with q % of the documents at or under it
        walk = F.aggregate(
            "sketch",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("b")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["b"], F.when((a["seen"] + x["n"]) * 100 >= F.col("total") * q, x["bucket"])).alias("b")))
        return bucket_top(walk["b"])

    found = group.select(*keys, "metric", F.col("total"), at(50).alias("q50"), at(25).alias("q25"))
    return found.select(*keys, "metric", F.col("total").alias(f"n{mark}"), F.col("q50").alias(f"mid{mark}"), F.greatest(F.col("q50") - F.col("q25"), F.lit(1)).alias(f"spread{mark}"))


def _shrunk(x: str, n: str, to: str | Column) -> Column:
    to = F.col(to) if isinstance(to, str) else to
    return F.call_function("div", F.col(n) * F.col(x) + SHRINK * to, F.col(n) + SHRINK)


def fences(measured: DataFrame) -> DataFrame:
    """lang, source, then a column cut_<metric> for each ratio: the document's upper fence."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in RATIOS])
    cells = measured.select("lang", "source", F.explode(pairs).alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    own = _quantiles(cells, ["lang", "source"], "")
    every = _quantiles(cells, [], "3").withColumnRenamed("metric", "m3")
    lang = _quantiles(cells, ["lang"], "2").join(F.broadcast(every), F.col("metric") == F.col("m3"))  # one row per ratio
    lang = lang.select(F.col("lang").alias("l2"), F.col("metric").alias("m2"), _shrunk("mid2", "n2", "mid3").alias("mid2"), _shrunk("spread2", "n2", "spread3").alias("spread2"))
    best = own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("metric") == F.col("m2")))
    mid, spread = _shrunk("mid", "n", "mid2"), F.least(_shrunk("spread", "n", "spread2"), 2 * F.col("spread2"))
    wide = F.col("mid2") + FENCE * F.col("spread2")
    fence = F.when(mid <= wide, mid + FENCE * spread).otherwise(wide)
    return best.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, fence)).alias(f"cut_{m}") for m in RATIOS])


def judge(spark: SparkSession, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the base counts and ratios, base_failed, cut_<ratio>, kept, a row per row; with the columns ``carry`` of CARRIED."""
    stage = Stage(spark, "rules")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in (*COUNTS, *RATIOS)) + "".join(f", {c} {'string' if c == 'text' else 'long'}" for c in carry)
    measured = stage.write(docs.select("doc_id", "lang", "source", *{"text", *carry}).mapInArrow(batched(_measured(carry)), schema), "measured")
    cuts = stage.write(fences(measured), "fences").withColumnsRenamed({"lang": "cut_lang", "source": "cut_source"})
    same = F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source"))
    out = measured.join(sized_broadcast(cuts), same, "left").drop("cut_lang", "cut_source")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for m in RATIOS:
        within = within & (F.col(m) <= F.col(f"cut_{m}"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)
