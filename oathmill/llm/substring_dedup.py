"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words. A word goes if a window over it has the
same words as one that starts in a document with a smaller doc_id. Windows are
judged on the input.

Each window has a key: the smallest hash among its GRAM-word grams. Equal windows
have equal keys, and neighbouring windows mostly share theirs, so documents have
about one key for five words and no window is left out. The index is a folder with
immutable runs (key, first and last doc_id), each bucketed by key and sorted within
its buckets, and a manifest that names the runs in force. A batch becomes a run,
which is merge-joined with the older runs bucket by bucket, without moving or sorting
them; FAN_IN runs of one level are merged into one of the next. A folder can be opened
again for later batches. Keys that two documents share are candidates.

Candidates are verified: first whole stretches of windows under one key, grouped by
their very words; then, where one key has several different stretches, window by window,
by the key and two 64-bit hashes of its 13 words, which come from two hashes of each word under
different seeds and roll with different factors: words that collide in one do not in the other. Only
stretches that no smaller document has whole need the second step.

Null and empty texts have no words. Rows that repeat a doc_id are judged apart, and never
against each other; equal ones share their spans. What is gathered for a row is bounded by its own text,
whatever the number of rows with its doc_id. Rows with a null doc_id keep all words
and remove none. Of equal windows the one in the smallest doc_id stays, and all of them
that are in that document. A long text is cut whole, in memory of its own size; its keys and
stretches are rows. Extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Stage, batched, remove, settings, text_bytes

WINDOW, GRAM = 13, 5
#: Batches of a one-off run, and how many runs of one level are compacted into one.
BATCHES, FAN_IN = 3, 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)
#: Texts are cut so many bytes at a time (a longer one by itself); words of more bytes are hashed one by one.
GROUP_BYTES, LONG = 262_144, 64
_IN_WORD = np.array([c not in ASCII_SPACE for c in range(256)])
#: The low bytes of a number, by how many.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Joins hash their smaller side instead of sorting both where each of its partitions, as it was shuffled, has at most so many bytes.
HASHED = "64m"
#: Seed of the words' second hash, and the parts that the texts of one doc_id are told apart by.
SECOND, SALTS = 0x5EED, 32_768


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * odd + h[k : k + len(out)]
    return _mix(out)


class Words:
    """The words of some texts, side by side: where they begin and end, their sizes and hashes.

    Words are hashed all at once, eight bytes at a time, as a call for each word costs more than its hash; those over LONG bytes are hashed by themselves.
    """

    def __init__(self, texts: list[bytes]):
        raw = b" " + b" ".join(texts) + b" " * 9
        self.data = np.frombuffer(raw, np.uint8)
        self.within = _IN_WORD[self.data]
        edges = np.flatnonzero(self.within[1:] != self.within[:-1]) + 1
        self.begin, self.end = edges[::2], edges[1::2]
        self.sizes = self.end - self.begin
        starts = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        #: each text's first word, and at last the number of words
        self.first = np.append(0, np.searchsorted(self.begin, starts))
        self.hashes = self._hashed(raw)

    def _hashed(self, raw: bytes) -> np.ndarray:
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        with np.errstate(over="ignore"):
            h = _mix((eight[self.begin] & _LOW[np.minimum(self.sizes, 8)]) * _M1 + self.sizes.astype(np.uint64))
            more, k = np.flatnonzero(self.sizes > 8), 8
            while len(more) and k < LONG:
                part = eight[self.begin[more] + k] & _LOW[np.minimum(self.sizes[more] - k, 8)]
                h[more] = _mix((h[more] ^ part) * _M2)
                k += 8
                more = more[self.sizes[more] > k]
        for i in more.tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[self.begin[i] : self.end[i]])
        return h

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first word, windows and key of each run of windows under one key; a key is the least hash of a window's grams."""
        if len(self.begin) < WINDOW:
            return (*(np.empty(0, np.int64) for _ in range(4)),)
        with np.errstate(over="ignore"):
            grams = _rolled(self.hashes, GRAM, _M1)
        n = len(self.begin) - WINDOW + 1
        keys = grams[:n].copy()
        for k in range(1, WINDOW - GRAM + 1):
            np.minimum(keys, grams[k : k + n], out=keys)
        new = np.append(True, keys[1:] != keys[:-1])
        # the windows that begin in a text's last words lie across texts
        last = self.first[1:] - (WINDOW - 1)
        new[self.first[:-1][self.first[:-1] < n]] = True
        new[last[(last >= self.first[:-1]) & (last < n)]] = True
        at = np.flatnonzero(new)
        times = np.append(at[1:], n) - at
        text = np.searchsorted(self.first, at, "right") - 1
        whole = at < last[text]
        return text[whole], at[whole], times[whole], keys[at[whole]].view(np.int64)

    def slices(self, at: np.ndarray, words: np.ndarray) -> list[bytes]:
        """So many words from each word ``at`` on, joined by a space."""
        keep = self.within.copy()
        keep[self.end] = True
        place = np.append(0, np.cumsum(self.sizes + 1))
        spaced = self.data[keep]
        spaced[place[1:] - 1] = 32
        joined = spaced.tobytes()
        return [joined[i:j] for i, j in zip(place[at].tolist(), (place[at + words] - 1).tolist(), strict=True)]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, some hundred KB at a time, and the first one's row."""
    texts, size, row = [], 0, 0
    for text in text_bytes(batch.column("text")):
        texts.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield row, texts
            row, texts, size = row + len(texts), [], 0
    if texts:
        yield row, texts


def _column(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)[rows]


def _distinct(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of distinct (text, key)."""
    order = np.lexsort((key, text))
    if len(order):
        order = order[np.append(True, (text[order][1:] != text[order][:-1]) | (key[order][1:] != key[order][:-1]))]
    return order


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in _grouped(batch):
            text, _, _, key = Words(texts).stretches()
            one = _distinct(text, key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[one], _column(batch, "doc_id", text[one] + row), _column(batch, "salt", text[one] + row))], ["key", "doc_id", "salt"])


def _salt() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("short").alias("salt")


def document_keys(docs: DataFrame) -> DataFrame:
    """key, doc_id, salt (a part of the text's hash): the distinct keys of each row."""
    return docs.where("doc_id is not null").select("doc_id", _salt(), "text").mapInArrow(batched(_keys), "key long, doc_id long, salt short")


class FingerprintIndex:
    """Runs of (key, first, last) in a folder; ``add`` takes batches in any order of doc_id.

    A run counts once the manifest names it, and the manifest is replaced in one move, so a lost job leaves the index
    as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {}
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._store = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = self._file(f"{self.path}/manifest.json")
        if self._store.exists(known):
            stream = self._store.open(known)
            try:
                self.manifest = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
        else:
            self.manifest = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "made": 0, "runs": []}

    def _save(self) -> None:
        new, known = self._file(f"{self.path}/manifest.new"), self._file(f"{self.path}/manifest.json")
        stream = self._store.create(new, True)
        try:
            stream.write(bytearray(json.dumps(self.manifest).encode()))
        finally:
            stream.close()
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        over = self.spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
        over[0] = getattr(files, "Options$Rename").OVERWRITE
        files.FileContext.getFileContext(self._store.getUri(), self._store.getConf()).rename(self._store.makeQualified(new), self._store.makeQualified(known), over)

    def merging(self):
        """Settings under which joins of runs read their buckets as they lie."""
        return settings(
            self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true", spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
            spark__sql__shuffle__partitions=str(self.manifest["buckets"]), spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__join__preferSortMergeJoin="true")

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table; the session's catalogue learns of it on first use."""
        if name not in self.tables:
            self.tables[name] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} (key BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.manifest['buckets']} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"run{self.manifest['made']}_level{level}_{uuid.uuid4().hex[:8]}"
        self.manifest["made"] += 1
        table = self.tables[name] = f"run_{uuid.uuid4().hex}"
        with self.merging():
            rows.select("key", "first", "last").write.format("parquet").option("path", f"{self.path}/{name}").bucketBy(self.manifest["buckets"], "key").sortBy("key").saveAsTable(table)
        return name

    def add(self, keys: DataFrame, stage: Stage) -> DataFrame:
        """Index a batch of (key, doc_id); gives the keys that it shares with the index or within itself, written in ``stage``."""
        name = self._write(keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), 0)
        stage.free()
        with self.merging():
            shared = stage.write(self.probe(name), f"shared{self.manifest['made']}")
        self.manifest["runs"].append({"level": 0, "name": name})
        self._save()
        self.compact()
        return shared

    def probe(self, name: str) -> DataFrame:
        """Keys of a run that two of its own documents have, or a run in force: a merge join, bucket by bucket."""
        found, met = self.run(name), F.col("first") < F.col("last")
        for i, r in enumerate(self.manifest["runs"]):
            found = found.join(self.run(r["name"]).select("key", F.lit(True).alias(f"seen{i}")), "key", "left")
            met = met | F.col(f"seen{i}").isNotNull()
        return found.where(met).select("key")

    def compact(self) -> None:
        """Merge FAN_IN runs of one level into one of the next, as often as there are so many."""
        while True:
            levels: dict[int, list[str]] = {}
            for r in self.manifest["runs"]:
                levels.setdefault(r["level"], []).append(r["name"])
            full = min((k for k, names in levels.items() if len(names) >= FAN_IN), default=None)
            if full is None:
                return
            old = levels[full][:FAN_IN]
            rows = self.run(old[0])
            for name in old[1:]:
                other = self.run(name).select("key", F.col("first").alias("first2"), F.col("last").alias("last2"))
                rows = rows.join(other, "key", "full").select("key", F.least("first", "first2").alias("first"), F.greatest("last", "last2").alias("last"))
            new = self._write(rows, full + 1)
            self.manifest["runs"] = [r for r in self.manifest["runs"] if r["name"] not in old] + [{"level": full + 1, "name": new}]
            self._save()
            for name in old:
                self._forget(name)
                remove(self.spark, f"{self.path}/{name}")

    def _forget(self, name: str) -> None:
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")

    def close(self) -> None:
        """Take the runs out of the session's catalogue; the folder stays."""
        for name in list(self.tables):
            self._forget(name)

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.path)


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, th, text, wanted): the stretches under wanted keys, with their words."""
    for batch in batches:
        wanted, sizes = batch.column("wanted").flatten().to_numpy(zero_copy_only=False), batch.column("wanted").value_lengths().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        for row, texts in _grouped(batch):
            words = Words(texts)
            text, at, n, key = words.stretches()
            known = _told(np.repeat(np.arange(len(texts)), sizes[row : row + len(texts)]), wanted[ends[row] : ends[row + len(texts)]])
            chosen = np.isin(_told(text, key), known)
            text, at, n, key = (x[chosen] for x in (text, at, n, key))
            columns = [key, pa.array(words.slices(at, n + (WINDOW - 1)), pa.binary()), _column(batch, "doc_id", text + row), _column(batch, "th", text + row), (at - words.first[text]).astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "words", "doc_id", "th", "at", "n"])


def _told(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a text's key. Should two meet, a stretch under a key that no other document has is verified in vain."""
    with np.errstate(over="ignore"):
        return key.view(np.uint64) ^ _mix((text.astype(np.uint64) + np.uint64(1)) * _M3)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of stretches (key, words, doc_id, th, at), each with two hashes of its words."""
    for batch in batches:
        texts = [w.as_py() for w in batch.column("words")]
        if not texts:
            continue
        parts = b" ".join(texts).split(b" ")
        sizes = np.array([t.count(b" ") + 1 for t in texts], dtype=np.int64)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
        g = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SECOND)), np.uint64, len(parts))
        with np.errstate(over="ignore"):
            one, two = _rolled(h, WINDOW, _M2), _rolled(g, WINDOW, _M3)
        times = sizes - WINDOW + 1  # the rest of the rolled windows lie across stretches
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(np.cumsum(sizes) - sizes, times) + within
        again = {c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times) for c in ("key", "doc_id", "th", "at")}
        columns = [again["key"], one[where].view(np.int64), two[where].view(np.int64), again["doc_id"], again["th"], (again["at"] + within).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "window", "again", "doc_id", "th", "at"])


def covered(n_words: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which words the windows cover that start at the n words from ``at`` on."""
    marks = np.bincount(at, minlength=n_words + 1) - np.bincount(at + n + (WINDOW - 1), minlength=n_words + 1)
    return np.cumsum(marks)[:-1] > 0


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(at, n) of each row's spans; None where there are none."""
    flat = column.flatten()
    at, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
    sizes = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    ends = np.cumsum(sizes)
    for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        yield (at[begin:end], n[begin:end]) if end > begin else None


def candidates(stage: Stage, index: FingerprintIndex, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key: those that two of ``docs`` share, from batches of (key, doc_id) in order of doc_id."""
    ends = docs.agg(F.percentile_approx("doc_id", [i / BATCHES for i in range(1, BATCHES)], 10_000).alias("q")).first()["q"] or []
    shared, low = None, None
    for end in [*sorted(set(ends)), None]:
        batch = keys if low is None else keys.where(F.col("doc_id") > low)
        found = index.add(batch if end is None else batch.where(F.col("doc_id") <= end), stage)
        shared = found if shared is None else shared.unionByName(found)
        low = end
        stage.free()
    return stage.write(shared.distinct(), "candidates")


def removal_spans(spark: SparkSession, docs: DataFrame) -> tuple[Stage, DataFrame]:
    """doc_id, th (hash of the text), spans: the windows to remove, as (first window, how many)."""
    stage = Stage(spark, "substrings")
    with settings(spark, spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold=HASHED):
        return stage, _spans_of(stage, docs)


def _spans_of(stage: Stage, docs: DataFrame) -> DataFrame:
    index = FingerprintIndex(stage.spark, f"{stage.root}/index")
    try:
        keys = stage.write(document_keys(docs), "keys")
        shared = candidates(stage, index, docs, keys)
    finally:  # no run stays in the session's catalogue
        index.drop()
    stage.free()
    # by text, not by doc_id alone: rows that repeat a doc_id gather no more than their own keys
    wanted = stage.write(keys.join(shared, "key").groupBy("doc_id", "salt").agg(F.collect_set("key").alias("wanted")), "wanted")
    stage.free()
    for name in ("keys", "candidates"):
        stage.drop(name)
    hashed = docs.where("doc_id is not null").select("doc_id", _salt(), F.xxhash64("text").alias("th"), "text")
    kinds = "key long, words binary, doc_id long, th long, at int, n int"
    # neighbouring stretches share 12 words, which the codec finds
    found = stage.write(hashed.join(wanted, ["doc_id", "salt"]).select("doc_id", "th", "text", "wanted").mapInArrow(batched(_stretched), kinds), "stretches", "zstd")
    stage.drop("wanted")
    stage.free()
    # grouped by the words themselves; their hash only spares the later joins the words
    same = F.xxhash64("words")
    firsts = stage.write(found.groupBy("key", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).select("key", same.alias("whole"), "words", "first", "last"), "firsts", "zstd")
    stage.free()
    kinds_of = stage.write(firsts.groupBy("key").agg(F.count("*").alias("kinds"), F.count_distinct("whole").alias("hashes")).where("kinds > 1"), "kinds")
    stage.free()
    mixed = [] if kinds_of.where("hashes < kinds").isEmpty() else ["words"]  # two stretches with one hash: join by words
    by = ["key", "whole", *mixed]
    rows = found.select("key", same.alias("whole"), *mixed, "doc_id", "th", "at", "n")
    later = stage.write(rows.join(firsts.where("first < last").select(*by, "first"), by).where("doc_id > first").select("doc_id", "th", "at", "n"), "later")
    stage.free()
    # keys with different stretches: compare windows of each stretch's first document
    several = stage.write(firsts.join(kinds_of.select("key"), "key", "left_semi").select("key", "whole", "words", "first"), "several", "zstd")
    stage.free()
    open_rows = rows.select(*by, "doc_id", "th", "at").join(several, by).where("doc_id = first")
    windows = open_rows.select("key", "words", "doc_id", "th", "at").mapInArrow(batched(_windows), "key long, window long, again long, doc_id long, th long, at int")
    windows = stage.write(windows, "windows")
    for name in ("stretches", "firsts", "several", "kinds"):
        stage.drop(name)
    stage.free()
    # a table of its own: a join of two plain shuffles can split a hot window's rows, one with an aggregate cannot
    window = ["key", "window", "again"]
    lowest = stage.write(windows.groupBy(*window).agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).where("lowest < highest").drop("highest"), "lowest")
    stage.free()
    single = stage.write(windows.join(lowest, window).where("doc_id > lowest").select("doc_id", "th", "at", F.lit(1).alias("n")), "single")
    for name in ("windows", "lowest"):
        stage.drop(name)
    stage.free()
    spans = stage.write(later.unionByName(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    for name in ("later", "single"):
        stage.drop(name)
    stage.free()
    return spans


def with_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' rows and their removal spans (null: none)."""
    _, spans = removal_spans(spark, docs)
    keyed = docs.withColumn("th", F.xxhash64("text"))
    return keyed.join(spans, ["doc_id", "th"], "left")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(text_bytes(batch.column("text")), _spans(batch.column("spans")), strict=True):
            words, n = text.split(), 0
            kept = words
            if spans:
                gone = covered(len(words), *spans)
                n = int(gone.sum())
                kept = compress(words, (~gone).tolist())
            rows.append((len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removal_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return with_spans(spark, docs.select("doc_id", "text")).select("doc_id", "text", "spans").mapInArrow(batched(_digests), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, spans: tuple[np.ndarray, np.ndarray] | None) -> str:
    """The text without the words that spans (at, n) remove and the white space after each; other white space stays."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)]
    gone = covered(len(at), *spans)
    parts = [raw[: at[0]]] if at else [raw]
    for i, (a, g) in enumerate(zip(at, gone.tolist(), strict=True)):
        if not g:
            parts.append(raw[a : at[i + 1] if i + 1 < len(at) else len(raw)])
    return b"".join(parts).decode()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else without(t, s) for t, s in zip(batch.column("text").to_pylist(), _spans(batch.column("spans")), strict=True)]
        n = [None if t is None else len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), batch.column("lang").cast(pa.string()), batch.column("source").cast(pa.string()), pa.array(n, pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars with the repeated words removed."""
    rows = with_spans(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return rows.select("doc_id", "text", "lang", "source", "spans").mapInArrow(batched(_texts), "doc_id long, text string, lang string, source string, n_chars long")
