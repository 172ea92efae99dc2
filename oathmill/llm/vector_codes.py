"""Product codes of vectors: Lloyd's rounds with Elkan's bounds, in whole numbers.

A component x becomes floor(4096 * x); a vector is cut into PARTS equal consecutive parts. The codebook of a part
begins as that part of the ENTRIES smallest vec_ids (nulls last, equal ids by their components). A round assigns each
part to the nearest entry (squared distance, ties to the lower index) and moves each entry to the floored mean of its
parts; unused entries stay. After ROUNDS rounds parts are assigned once more.

Between rounds a row keeps, for each part, its entry, an upper bound of the distance to it and one lower bound per
entry, in a table of the shared folder. A round shifts them by how far entries have moved (upper ones up, lower ones
down) and passes over an entry only if the upper bound is strictly below its lower bound, or strictly below half the
distance between the two entries. All other distances are taken in 64-bit integers, and the first of the smallest
wins, so an entry at the same distance is never passed over. Bounds are rounded away from what they bound.
What leaves the executors in a round is one sum and count per part and entry.

Rows whose vector is null, or has null or non-finite components, are dropped. All others must have one length, a
multiple of PARTS, and components below 131,072, so that sums of squares are exact; else the job says so and stops.
With fewer than ENTRIES rows there are as many entries as rows. Repeated rows are coded one by one and weigh
that often. A null vec_id or label is kept; null labels are one label. Empty vectors have empty parts at distance 0.
Extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stage, batched, sized_broadcast

PARTS, ENTRIES, ROUNDS, GRAIN, MOST = 8, 16, 6, 4096, 131_072
ROWS = 4096
STATE = "vec_id long, label int, v array<int>, entry binary, upper binary, lower binary, work int"
_NAMES = ["vec_id", "label", "v", "entry", "upper", "lower", "work"]


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that are kept."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    small = F.forall("embedding", lambda x: F.abs(x) < MOST)
    checked = F.when(small, F.transform("embedding", lambda x: F.floor(x.cast("double") * GRAIN).cast("int"))).otherwise(
        F.raise_error(F.lit(f"vector components must be below {MOST}")).cast("array<int>"))
    return rows.where(F.col("embedding").isNotNull()).where(sound).select(F.col("vec_id").cast("long"), F.col("label").cast("int"), checked.alias("v"))


def first_entries(vectors: DataFrame) -> np.ndarray:
    """Codebooks (part, entry, position) from the smallest vec_ids: at most ENTRIES rows."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    if not rows:
        return np.zeros((PARTS, 0, 0), np.int64)
    size = len(rows[0]["v"])
    if size % PARTS or any(len(r["v"]) != size for r in rows):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, size // PARTS).transpose(1, 0, 2).copy()


def _up(x: np.ndarray) -> np.ndarray:
    """float32 at or above x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """float32 at or below x, 0 at least."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def distances(book: np.ndarray) -> np.ndarray:
    """Squared distances between the entries of one codebook."""
    return ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)


def assign(x: np.ndarray, book: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One part of many rows: (entry, upper, lower, distances taken per row) by the bounds; nothing given is changed."""
    n, k = len(x), len(book)
    half = np.sqrt(distances(book).astype(np.float64)) / 2
    np.fill_diagonal(half, np.inf)
    half = _down(half)
    every = np.arange(n)
    open_ = (upper[:, None] >= lower) & (upper[:, None] >= half[entry])
    open_[every, entry] = False
    rows = np.flatnonzero(open_.any(axis=1))
    work = np.zeros(n, np.int32)
    if not len(rows):
        return entry, upper, lower, work
    entry, upper, lower = entry.copy(), upper.copy(), lower.copy()
    # first the true distance to the row's own entry, which may close the others
    own = ((x[rows] - book[entry[rows]]) ** 2).sum(axis=1)
    work[rows] += 1
    root = np.sqrt(own.astype(np.float64))
    upper[rows], lower[rows, entry[rows]] = _up(root), _down(root)
    still = open_[rows] & (upper[rows][:, None] >= lower[rows]) & (upper[rows][:, None] >= half[entry[rows]])
    at, j = np.nonzero(still)
    taken = np.full((len(rows), k), np.iinfo(np.int64).max)
    taken[np.arange(len(rows)), entry[rows]] = own
    # in blocks, so that a batch's differences do not all stand in memory
    for b in range(0, len(at), 65_536):
        p, q = at[b : b + 65_536], j[b : b + 65_536]
        d = ((x[rows[p]] - book[q]) ** 2).sum(axis=1)
        taken[p, q] = d
        lower[rows[p], q] = _down(np.sqrt(d.astype(np.float64)))
    work[rows] += still.sum(axis=1, dtype=np.int32)
    entry[rows] = taken.argmin(axis=1)  # the first of equals
    upper[rows] = _up(np.sqrt(taken.min(axis=1).astype(np.float64)))
    return entry, upper, lower, work


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of a batch as (part, row, position)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * size or (np.asarray(column.value_lengths()) != size).any():
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    return flat.astype(np.int64).reshape(len(column), PARTS, size // PARTS).transpose(1, 0, 2)


def _stack(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _apart(x: np.ndarray) -> pa.Array:
    """A row's numbers as one binary value."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _round(books: np.ndarray, moved: np.ndarray | None):
    """One assignment of a batch. moved: (part, entry), how far entries went since the last; None: no bounds yet."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("v"), parts * width)
            if moved is None:
                entry, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, k), np.float32)
            else:
                entry, upper, lower = _stack(batch.column("entry"), np.uint8, parts), _stack(batch.column("upper"), np.float32, parts), _stack(batch.column("lower"), np.float32, parts, k)
            after, up, low, work = np.empty_like(entry), np.empty_like(upper), np.empty_like(lower), np.zeros(n, np.int32)
            for p in range(parts):
                own, u, lo = entry[:, p].astype(np.int64), upper[:, p], lower[:, p]
                if moved is not None:
                    u, lo = _up(u.astype(np.float64) + moved[p][own]), _down(lo.astype(np.float64) - moved[p])
                after[:, p], up[:, p], low[:, p], taken = assign(x[p], books[p], own, u, lo)
                work += taken
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("v"), _apart(after), _apart(up), _apart(low), pa.array(work)], _NAMES)

    return run


def _sums(parts: int, k: int, width: int):
    """(part, entry, n, sums) of a task's rows: at most one row for each part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, entry = _matrix(batch.column("v"), parts * width), _stack(batch.column("entry"), np.uint8, parts)
                for p in range(parts):
                    np.add.at(sums[p], entry[:, p], x[p])
                    counts[p] += np.bincount(entry[:, p], minlength=k)
        at, j = np.nonzero(counts)
        rows = [pa.array(at.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[at, j]), pa.array(list(sums[at, j]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, ["part", "entry", "n", "sums"])

    return run


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floored means of each entry's parts; unused entries as they were. PARTS * ENTRIES rows reach the driver."""
    parts, k, width = books.shape
    sums = state.select("v", "entry").mapInArrow(_sums(parts, k, width), "part int, entry int, n long, sums array<long>")
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    after = books.copy()
    for r in total.collect():
        after[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return after


def _final(books: np.ndarray):
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, entry = _matrix(batch.column("v"), parts * width), _stack(batch.column("entry"), np.uint8, parts)
            error = sum(((x[p] - books[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(parts))
            codes = pa.array([r.tobytes().hex() for r in np.ascontiguousarray(entry)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(stage: Stage, vectors: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Codebooks after ROUNDS rounds, and the state of every row after the last assignment."""
    books, moved = first_entries(vectors), None
    state = vectors
    for turn in range(ROUNDS + 1):
        state = stage.write(state.mapInArrow(batched(_round(books, moved), ROWS), STATE), f"state{turn}")
        if turn:
            stage.drop(f"state{turn - 1}")
        if turn == ROUNDS:
            break
        after = moved_entries(state, books)
        # a hair above the true way, so that bounds stay bounds
        moved = np.nextafter(np.sqrt(((after - books) ** 2).sum(axis=2).astype(np.float64)), np.inf) if books.shape[1] else np.zeros(books.shape[:2])
        books = after
    return books, state


def encode(spark: SparkSession, rows: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Codebooks, and vec_id, label, code, error, work (distances taken in all rounds' last one)."""
    stage = Stage(spark, "vectors")
    vectors = stage.write(whole_vectors(rows), "vectors")
    books, state = train(stage, vectors)
    coded = state.select("vec_id", "label", "v", "entry").mapInArrow(batched(_final(books), ROWS), "vec_id long, label int, code string, error long")
    return books, stage.write(coded, "coded")


def codes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    books, coded = encode(spark, rows)
    key = (F.col("label").isNull().alias("nameless"), F.coalesce("label", F.lit(0)).alias("name"))
    sums = coded.groupBy(*key).agg(F.sum("error").alias("label_error"))
    out = coded.select("vec_id", "code", "error", *key).join(sized_broadcast(sums), ["nameless", "name"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
