"""Ranked lexical search: dual-sorted wavelet trees per shard, searched best-first with subtree bounds.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. A document's impact for a
term is (1000000000 * tf) div (1000 * tf + 20 * m), its score the sum of weight times impact over the query's terms.

Shards are cut within the partitions of the input, so texts are not shuffled: a shard is closed at SHARD_DOCS documents
or SHARD_POSTINGS postings, and is one row of the index table. Its postings stand term by term, each term's in order of
falling impact; a wavelet matrix over the documents' numbers (in order of doc_id) makes them navigable by document too:
a node is a range of documents, and what a term has in it is a range of positions, still in order of impact. So a
term's first position in a node is its largest impact there, and weights times these, summed, bound every score in the
node. Nodes are taken best first (in groups of GROUP, to work on arrays) and cut into halves until they are
single documents with their exact score; nodes that cannot reach the k-th best score so far are left. Bounds of inner
nodes are kept in steps of STEP, rounded up; scores are exact 64-bit integers.

A worker carries its k-th best scores from shard to shard. The best k of each task meet in SALTS groups per item, then
in one. Items are searched in blocks of BLOCK items, each a pass over the index, so any number of items may be asked.

Documents without a term (null, empty) are not counted and never found. Rows that repeat a doc_id are documents of their
own; a null doc_id comes last among equal scores. Rows of one item_id, nulls included, are one item with all their
terms; an item without terms finds nothing. A long text is one document, whole. Extra columns are left out; an empty
table of documents or items gives an empty table.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Stage, batched, settings, sized_broadcast, text_bytes

SHARD_DOCS, SHARD_POSTINGS, GROUP, BLOCK, SALTS, STEP = 8192, 1 << 19, 64, 1024, 64, 4096
#: Bytes of a row group of the index. Parquet looks at its size every 100 rows, which a task's shards seldom are, so it must after each.
ROW_GROUP = 1 << 25
_GROUPS = {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: How shards are read: one at a time. Spark's vectorised reader decodes thousands of rows at once, which are all the shards of a file.
_SINGLY = {"spark__sql__parquet__enableVectorizedReader": "false", "spark__sql__execution__arrow__maxRecordsPerBatch": "1"}
#: What is no part of a term becomes a space, A-Z small letters.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "docs array<long>, terms array<string>, df array<int>, bits binary, bounds binary, impacts binary"
_KINDS = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["docs", "terms", "df", "bits", "bounds", "impacts"]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [n for t in text_bytes(batch.column("text")) if (n := len(terms_of(t)))]
        yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["n", "l"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    row = docs.select("text").mapInArrow(batched(_lengths), "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return row["n"], row["l"]


def _levels(n: int) -> int:
    """Halvings that take n documents to single ones; 1 at least."""
    return max(1, (n - 1).bit_length())


def build(ids: list[int | None], terms: list[bytes], tfs: list[int], sizes: list[int], lengths: list[int], n_all: int, l_all: int) -> list:
    """The columns of a shard: ids and lengths per document, ``sizes`` distinct terms each, which stand one after the other."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms))
    m = np.array([50 + 50 * n * n_all // l_all for n in lengths], np.int64)
    doc, tf, m = np.repeat(number, sizes), np.array(tfs, np.int64), np.repeat(m, sizes)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * m)  # below 2 ** 20
    levels = _levels(len(ids))
    keys = np.sort((((term << 20) | ((1 << 20) - 1 - impact)) << levels) | doc)
    doc, impact = keys & ((1 << levels) - 1), (1 << 20) - 1 - ((keys >> levels) & ((1 << 20) - 1))
    df = np.bincount(keys >> (levels + 20), minlength=len(vocabulary)).astype(np.int32)
    doc, impact = doc.astype(np.int32), impact.astype(np.int32)
    bits, bounds = [], []
    for level in range(levels):
        bounds.append((impact // STEP).astype(np.uint8).tobytes())
        one = (doc >> (levels - 1 - level) & 1).astype(bool)
        bits.append(np.packbits(np.append(one, np.zeros(-len(one) % 64 + 64, bool)), bitorder="little").tobytes())
        doc, impact = np.concatenate([doc[~one], doc[one]]), np.concatenate([impact[~one], impact[one]])
    words = [w.decode() for w in vocabulary]
    return [[ids[i] for i in order], words, df.tolist(), b"".join(bits), b"".join(bounds), impact.tobytes()]


def _shards(n_all: int, l_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, tfs, sizes, lengths = [], [], [], [], []

        def close() -> pa.RecordBatch:
            columns = build(ids, terms, tfs, sizes, lengths, n_all, l_all)
            for held in (ids, terms, tfs, sizes, lengths):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), text_bytes(batch.column("text")), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                tf = Counter(found)
                if ids and (len(ids) >= SHARD_DOCS or len(terms) + len(tf) > SHARD_POSTINGS):
                    yield close()
                ids.append(doc_id.as_py())
                terms += tf
                tfs += tf.values()
                sizes.append(len(tf))
                lengths.append(len(found))
        if ids:
            yield close()

    return run


@dataclass
class Index:
    """The shards as a table, with N and L."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def index(stage: Stage, docs: DataFrame, name: str = "index") -> Index:
    """Write the shards of all documents (doc_id, text) as a table of the stage."""
    n, size = totals(docs)
    shards = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batched(_shards(n, size)), INDEX)
    path = f"{stage.root}/{name}"
    shards.write.options(**_GROUPS).parquet(path, compression="zstd")
    return Index(stage.spark.read.schema(INDEX).parquet(path), n, size)


class Shard:
    """A shard ready for searches."""

    def __init__(self, n_docs: int, terms: list[str], df: np.ndarray, bits: bytes, bounds: bytes, impacts: bytes):
        self.levels = _levels(n_docs)
        ends = np.cumsum(df, dtype=np.int64)
        self.where = dict(zip(terms, zip((ends - df).tolist(), ends.tolist(), strict=True), strict=True))
        self.impacts = np.frombuffer(impacts, np.int32)
        self.size = len(self.impacts)
        self.bounds = np.frombuffer(bounds, np.uint8)
        self.words = np.frombuffer(bits, np.uint64)
        self.width = len(self.words) // self.levels
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(self.levels, self.width)
        before = np.cumsum(ones, axis=1)
        self.zeros = self.size - before[:, -1]
        self.before = (before - ones).reshape(-1)

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before a position."""
        word = level * self.width + (at >> 6)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def largest(self, level: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Upper bounds of the impacts in ranges of a level (one number per row); exact on the last level."""
        has, last = begin < end, (level == self.levels)[:, None]
        at = np.where(has, begin, 0)
        inner = self.bounds[np.minimum(level, self.levels - 1)[:, None] * self.size + at].astype(np.int64) * STEP + STEP - 1
        return np.where(has, np.where(last, self.impacts[at], inner), 0)

    def best(self, asked: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers) of the k best documents, ties by number, without those below ``least`` (1 at least)."""
        known = [(*self.where[t], w) for t, w in asked if t in self.where and w > 0]
        scores, numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        if not known:
            return scores, numbers
        begin, end, weight = (np.array(c, np.int64) for c in zip(*known, strict=True))
        begin, end = begin[None, :], end[None, :]
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = self.largest(level, begin, end) @ weight
        while len(bound):
            if len(bound) > GROUP:
                top = np.argpartition(-bound, GROUP)
                now, later = top[:GROUP], top[GROUP:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            lv, b, e = level[now], begin[now], end[now]
            b1, e1, z = self.ones(lv[:, None], b), self.ones(lv[:, None], e), self.zeros[lv][:, None]
            b2, e2 = np.concatenate([b - b1, z + b1]), np.concatenate([e - e1, z + e1])
            lv2, node2 = np.tile(lv + 1, 2), np.concatenate([node[now] * 2, node[now] * 2 + 1])
            bound2 = self.largest(lv2, b2, e2) @ weight
            leaf = (lv2 == self.levels) & (bound2 >= least)
            if leaf.any():
                scores, numbers = np.concatenate([scores, bound2[leaf]]), np.concatenate([numbers, node2[leaf]])
                if len(scores) > k:
                    keep = np.lexsort((numbers, -scores))[:k]
                    scores, numbers = scores[keep], numbers[keep]
                if len(scores) == k:
                    least = max(least, int(scores.min()))
            inner = lv2 < self.levels
            level, node, bound = (np.concatenate([old[later], new[inner]]) for old, new in ((level, lv2), (node, node2), (bound, bound2)))
            begin, end = np.concatenate([begin[later], b2[inner]]), np.concatenate([end[later], e2[inner]])
            open_ = bound >= least
            if not open_.all():
                level, node, bound, begin, end = level[open_], node[open_], bound[open_], begin[open_], end[open_]
        return scores, numbers


def _found(asked: list[tuple[int, list[tuple[str, int]]]], k: int):
    """(item, doc_id, score): the best k of a task's shards per item, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in asked]  # heaps of (score, order of doc_id reversed, doc_id)
        for batch in batches:
            for i in range(batch.num_rows):
                docs, terms, df, bits, bounds, impacts = (batch.column(c)[i] for c in _NAMES)
                ids = docs.as_py()
                shard = Shard(len(ids), terms.as_py(), df.values.to_numpy(zero_copy_only=False), bits.as_py(), bounds.as_py(), impacts.as_py())
                for heap, (_, query) in zip(best, asked, strict=True):
                    least = heap[0][0] if len(heap) == k else 1
                    for score, number in zip(*(x.tolist() for x in shard.best(query, k, least)), strict=True):
                        d = ids[number]
                        entry = (score, float("-inf") if d is None else -d, d or 0)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry[:2] > heap[0][:2]:
                            heapq.heapreplace(heap, entry)
        rows = [(n, None if o == float("-inf") else d, s) for heap, (n, _) in zip(best, asked, strict=True) for s, o, d in heap]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item. Only A-Z is lowered."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def weights(found: Index, terms: DataFrame) -> DataFrame:
    """term, w for the given terms that documents hold: df is summed over the shards' own lists."""
    lists = found.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    df = lists.join(sized_broadcast(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((2.0 * found.n_docs + 2) / (F.col("df") * 2.0 + 1))).cast("long")
    return df.select("term", w.alias("w"))


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(stage: Stage, found: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text) with a score above 0."""
    terms = stage.write(item_terms(items), "terms")
    with settings(stage.spark, **_SINGLY):
        known = stage.write(weights(found, terms), "weights")
    asked = terms.join(known, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("query"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-terms.select("item_id").distinct().count() // BLOCK)))).cast("int")
    asked = stage.write(asked.withColumn("block", block), "asked")
    hits = None
    for number in [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]:
        rows = asked.where(F.col("block") == number).collect()  # about BLOCK items
        query = [(i, [(t["term"], t["w"]) for t in r["query"]]) for i, r in enumerate(rows)]
        names = stage.spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        out = found.shards.mapInArrow(_found(query, k), "item long, doc_id long, score long")
        with settings(stage.spark, **_SINGLY):
            out = stage.write(out.withColumn("salt", F.spark_partition_id() % SALTS), f"found{number}")
        part = _first(_first(out, k, "item", "salt").drop("rank"), k, "item").join(F.broadcast(names), "item")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return stage.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return hits.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Index the documents and search all items."""
    stage = Stage(spark, "search")
    return search(stage, index(stage, docs), items, k)
