"""Document fingerprints by locally consistent parsing.

The UTF-8 bytes of a text are parsed into phrases, phrases into phrases of
phrases, and so on up to one root. On each level runs of one name count as one
item; deterministic coin tossing (the lowest bit in which a name differs from the
one before, and its value, applied until labels are small) picks local minima as
phrase beginnings, so a boundary depends on a few neighbours only. A phrase is
named by a hash of the names in it, the same in every text. Equal substrings
therefore share the names of their interior phrases at any offset.

A fingerprint is the root's name and the SKETCH smallest of 32 bits of the names
from level FROM up (and of the root): a bottom-k sample that estimates how much
of two texts' phrases is shared. Null texts count as empty; an empty text has no
names, and is like an empty text (1) and like no other (0).

The next document is the one with the next smaller doc_id; after the last one
comes the first. Equal doc_ids are ordered by text; a null doc_id counts as the
smallest number. A single row is its own next. Repeated rows follow each other.
Documents are dealt into ranges of doc_id, each range gets a copy of the first
document of the next one, and tasks stream over sorted ranges. A long text is parsed
whole, alone, in memory of its own size. Extra columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stage, batched

FROM, SKETCH, MOST_LEVELS = 2, 32, 40
_ODD = np.uint64(0x9E3779B97F4A7C15)
LEAST_ID = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)
_BYTE_NAMES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 * (lowest bit that differs from the item before) + that bit."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    differ = x ^ before
    k = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    k[differ == 0] = 0
    bit = (x >> k.astype(x.dtype)).astype(np.uint8) & np.uint8(1)
    return (k.astype(np.uint8) << np.uint8(1)) | bit


def _parse(symbols: np.ndarray, names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases and the document of each. Items stand in document order."""
    n = len(symbols)
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    begins[1:] |= doc[1:] != doc[:-1]
    if not begins.all():  # runs become one item, named by what repeats and how often
        at = np.flatnonzero(begins)
        times = np.diff(np.append(at, n))
        symbols, doc, names = symbols[at], doc[at], names[at]
        many = times > 1
        names[many] = _mix(names[many] + times[many].astype(np.uint64) * _ODD)
        n = len(symbols)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    labels = _toss(symbols, first)
    for _ in range(2 if symbols.dtype == np.uint8 else 3):
        labels = _toss(labels, first)
    starts = np.zeros(n, dtype=bool)
    if n > 2:
        starts[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    starts[first] = True
    last = np.append(first[1:], n) - 1
    starts[last[~np.isin(last, first)]] = False  # no phrase of a text's last item alone
    at = np.flatnonzero(starts)
    offset = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    top = int(offset.max()) + 1
    powers = _POWERS if top <= len(_POWERS) else _powers(top)
    return _mix(np.add.reduceat(names * powers[offset], at) + np.diff(np.append(at, n)).astype(np.uint64)), doc[at]


def fingerprints(texts: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(root name, sorted sample of names) of each text; parsed together, each on its own."""
    with np.errstate(over="ignore"):
        root = np.zeros(len(texts), dtype=np.uint64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        symbols = np.frombuffer(b"".join(texts), dtype=np.uint8)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        names = _BYTE_NAMES[symbols]
        kept: list[np.ndarray] = []

        def keep(names: np.ndarray, doc: np.ndarray) -> None:
            kept.append((doc.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))

        for level in range(1, MOST_LEVELS):
            if not len(symbols):
                break
            names, doc = _parse(symbols, names, doc)
            if level >= FROM:
                keep(names, doc)
            single = np.append(True, doc[1:] != doc[:-1]) & np.append(doc[1:] != doc[:-1], True)
            if single.any():
                root[doc[single]] = names[single]
                if level < FROM:
                    keep(names[single], doc[single])
                names, doc = names[~single], doc[~single]
            symbols = names
        if len(symbols):  # deeper than any text gets: what is left names the root
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            root[doc[at]] = _mix(np.add.reduceat(_mix(names + np.arange(len(names), dtype=np.uint64)), at))
        found = np.unique(np.concatenate(kept)) if kept else np.empty(0, dtype=np.uint64)
    edges = np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [(int(root[i]), low[edges[i] : min(edges[i] + SKETCH, edges[i + 1])]) for i in range(len(texts))]


def shown(print_: tuple[int, np.ndarray]) -> str:
    return f"{print_[0]:016x}" + print_[1].astype(">u4").tobytes().hex()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of phrases that two texts have in common, of those that either has."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = set(a[1].tolist()), set(b[1].tolist())
    low = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in low) / len(low) if low else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: Texts parsed together hold about so many bytes; one longer text is parsed alone.
PARSE_BYTES = 2_000_000


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, copy, doc_id, text), sorted. A row's next is the row after it in its bucket; copies only close a bucket."""
    waiting: list[tuple[int, int, int | None, str]] = []
    size = 0

    def emit(closing: bool) -> pa.RecordBatch:
        rows = waiting
        prints = fingerprints([r[3].encode() for r in rows])
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
        after = fingerprints([c.encode() for c in changed])
        out = [(rows[i][2], len(rows[i][3]), hashlib.sha256(c.encode()).hexdigest(), shown(prints[i]), shown(f), likeness(prints[i], f), likeness(prints[i], prints[i + 1])) for i, c, f in zip(pairs, changed, after, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    for batch in batches:
        for bucket, copy, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            row = (bucket.as_py(), copy.as_py(), doc_id.as_py(), text.as_py() or "")
            waiting.append(row)
            size += len(row[3])
            if size > PARSE_BYTES and len(waiting) > 1:
                yield emit(False)
                waiting, size = [row], len(row[3])
    if waiting:
        yield emit(True)


def _buckets(spark: SparkSession, docs: DataFrame) -> list[int]:
    """Ids that end a range, ascending: about as many as four times the shuffle's partitions, whatever the rows."""
    want = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce("doc_id", F.lit(LEAST_ID))
    row = docs.select(order.alias("o")).agg(F.percentile_approx("o", [i / want for i in range(1, want)], max(10_000, 10 * want)).alias("q"), F.max("o").alias("top")).first()
    return sorted({q for q in row["q"] or [] if q < row["top"]}) + ([row["top"]] if row["top"] is not None else [])


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ends = _buckets(spark, docs)
    splits = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array(F.lit(0).cast("long"))
    count = max(1, len(ends))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(count.bit_length()))])
    order = F.coalesce("doc_id", F.lit(LEAST_ID))
    # how many splits are smaller than the id, by binary search
    bucket = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= count) & (F.get(splits, lo + s - 1) < order), lo + s).otherwise(lo))
    rows = docs.select("doc_id", "text", order.alias("o"), bucket.alias("b"))
    ends_range = F.get(splits, F.col("b")) == F.col("o")
    homes = F.when(ends_range, F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("copy")), F.struct(F.pmod(F.col("b") + 1, F.lit(count)).alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("b").alias("bucket"), F.lit(0).alias("copy"))))
    dealt = rows.select("doc_id", "text", "o", F.explode(homes).alias("h")).select("h.bucket", "h.copy", "doc_id", "text", "o")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.desc("o"), "text")
    return sorted_rows.select("bucket", "copy", "doc_id", "text").mapInArrow(batched(_chained), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
