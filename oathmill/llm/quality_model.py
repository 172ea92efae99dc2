"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the whole text alone. Cyclic boosting visits one feature after
the other; each visit fits a shallow tree on that feature's bins to the gradient
and adds a small step to the feature's lookup table. Then the pairs whose coarse
bins explain most of what is left get two-dimensional tables the same way. A
score is the logistic of a sum of table entries: vectorised bin additions.

Training reads at most TRAIN_ROWS labelled rows (those with the smallest hash of
doc_id): crc32 of the doc_id as text, modulo 3, is not 1. Rows without a label or
quality are not used; a doc_id with several labels counts with each. Without
training rows, or with one class only, every score is the smoothed share of
label 1. Null and empty texts have features 0 and a score. A null doc_id counts as an
empty string for the split. Repeated rows get equal scores. Extra columns are left
out; an empty table gives an empty table. A long text is measured whole in memory of its
own size. Ties in a cut go to the lowest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ASCII_SPACE, Stage, batched, code_points, text_bytes

TRAIN_ROWS = 30_000
BINS, COARSE, PAIRS = 32, 8, 8
MAIN_ROUNDS, PAIR_ROUNDS, RATE, LEAVES, SMOOTH = 120, 60, 0.15, 4, 5.0
FEATURES = ("log_words", "word_length", "symbols", "bars", "exclaims", "stops", "commas", "capitals", "digits", "beyond_ascii", "distinct_words", "top_word", "stutter", "distinct_pairs", "dup_lines", "words_a_line", "short_words", "long_words", "marked_words", "first_capitals")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = tuple(b"!|#*$%&<>")


def _less(text: bytes, drop: bytes) -> int:
    return len(text) - len(text.translate(None, drop))


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    begins = np.fromiter((w[0] for w in words), np.uint8, n)
    lines = [x for x in text.split(b"\n") if x.translate(None, ASCII_SPACE)]
    letters, chars = max(1, _less(text, _LETTERS)), max(1, code_points(text) - _less(text, ASCII_SPACE))
    number = dict(zip(counts, range(len(counts)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    return [
        float(np.log1p(n)), chars / n, _less(text, b"#*$%&<>") / n, text.count(b"|") / n, text.count(b"!") / n, text.count(b".") / n, text.count(b",") / n,
        _less(text, _UPPER) / letters, _less(text, b"0123456789") / chars, 1 - len(text.decode("utf-8", "replace").encode("ascii", "ignore")) / max(1, len(text)),
        len(counts) / n, max(counts.values()) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, len(np.unique(pairs)) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        float((lengths <= 3).mean()), float((lengths >= 8).mean()), float(np.isin(ends, _MARKS).mean()), float(((begins >= 65) & (begins <= 90)).mean()),
    ]


@dataclass
class Model:
    """Lookup tables: ``edges[f]`` cuts feature f into bins, ``tables[f]`` has a value per bin; pairs work on ``coarse[f]``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, f], side="right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in {g for p in self.pairs for g in p}}
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[f], bins[g]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with up to LEAVES leaves that cuts the ordered bins where it gains most."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTH)
    leaves = [(0, len(grad))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf in leaves:
            a, b = leaf
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), leaf, int(at[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(grad))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTH)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four quadrants."""
    g, h = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (grad, hess))
    best, out = 0.0, np.zeros(grad.shape)
    n, m = grad.shape
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            parts = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in cells]
            won = sum(x * x / (y + SMOOTH) for x, y in parts)
            if won > best:
                best, out = won, np.zeros(grad.shape)
                for (a, b, c, d), (x, y) in zip(cells, parts, strict=True):
                    out[a:b, c:d] = x / (y + SMOOTH)
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Model(base=float(np.log(rate / (1 - rate))))
    if len(set(y.tolist())) < 2:
        return model
    model.edges = [_cuts(x[:, f], BINS) for f in range(x.shape[1])]
    model.coarse = [_cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.edges)]
    model.tables = [np.zeros(len(c) + 1) for c in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(MAIN_ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(b, y - p, len(model.tables[f])), np.bincount(b, p * (1 - p), len(model.tables[f])))
            model.tables[f] += step
            total += step[b]
    grid = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.coarse)]
    size = [len(c) + 1 for c in model.coarse]

    def cells(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[f] * size[g] + grid[g], v, size[f] * size[g]).reshape(size[f], size[g])

    p = 1 / (1 + np.exp(-total))
    gains = sorted(((_cross(cells(f, g, y - p), cells(f, g, p * (1 - p)))[0], f, g) for f, g in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(f, g) for _, f, g in gains[:PAIRS]]
    model.pair_tables = [np.zeros((size[f], size[g])) for f, g in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (f, g) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _cross(cells(f, g, y - p), cells(f, g, p * (1 - p)))[1]
            model.pair_tables[k] += step
            total += step[grid[f], grid[g]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(t) for t in text_bytes(batch.column("text"))], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x[:, f].astype(np.float32)) for f in range(len(FEATURES)))], ["doc_id", *FEATURES])


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in FEATURES])


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    stage = Stage(spark, "quality")
    table = stage.write(docs.select("doc_id", "text").mapInArrow(batched(_featured), "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES)), "features")
    known = labels.where("quality is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 1).select(F.col("doc_id").alias("labelled"), "quality")
    known = known.join(table.select(F.col("doc_id").alias("labelled")), "labelled", "left_semi")  # labels of documents that are there
    sample = known.orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(TRAIN_ROWS)
    rows = table.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).orderBy(F.xxhash64("labelled"), "labelled", "quality", *FEATURES).limit(TRAIN_ROWS).select(*FEATURES, "quality").toArrow()  # at most TRAIN_ROWS
    data = np.column_stack([rows.column(f).to_numpy().astype(np.float64) for f in FEATURES]) if len(rows) else np.empty((0, len(FEATURES)))
    model = train(data, np.array(rows.column("quality").to_pylist(), dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    scored = table.mapInArrow(batched(run), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
