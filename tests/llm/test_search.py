from __future__ import annotations

import math
import random
import re

import pytest

from oathmill.llm import lexical_search as S
from oathmill.llm.shared import Stage

ITEMS = "item_id long, text string, term string, score long, item int, block int"


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 1, 1) for i, t in rows], ITEMS)


def _terms(text):
    return re.findall(S.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(docs, items, k):
    counted = [(d, t) for d, t in ((d, _terms(t)) for d, t in docs) if t]
    n_all, l_all, df = len(counted), sum(len(t) for _, t in counted), {}
    for _, t in counted:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, t in counted:
            m = 50 + 50 * len(t) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words if w in t)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def _same(spark, make_docs, docs, items, k=50):
    frame = make_docs([(d, t, "en", "a") for d, t in docs])
    got = [tuple(r) for r in S.ranked(spark, frame, _items(spark, items), k).collect()]
    assert sorted(got, key=str) == sorted(_plain(docs, items, k), key=str)
    return got


def _random(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "X9", "don't"]
    return [(rng.randrange(10**6), " ".join(rng.choice(words[: rng.choice((5, 20, 64))]) for _ in range(rng.choice((1, 5, 40, 200))))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranks_equal_a_full_scan(spark, make_docs, k):
    docs = _random(400)
    docs += docs[:40] + [(None, docs[3][1]), (None, None), (-5, docs[3][1]), (10**12, docs[3][1])]  # ties between copies
    _same(spark, make_docs, docs, [(1, "w1 W2 w2 w50"), (2, docs[3][1]), (3, "été 漢字"), (4, None), (5, ""), (6, "nothing here"), (None, "w3"), (None, "w4"), (1, "x9")], k)


def test_many_small_shards_and_blocks_give_the_same(spark, make_docs, monkeypatch):
    docs = _random(120, 2)
    monkeypatch.setattr(S, "BLOCK", 3)
    small = make_docs([(d, t, "en", "a") for d, t in docs])
    stage = Stage(spark, "tests")
    n, size = S.totals(small)
    batches = small.select("doc_id", "text").toArrow().to_batches()
    monkeypatch.setattr(S, "SHARD_DOCS", 7)
    shards = [b for b in S._shards(n, size)(iter(batches))]
    assert len(shards) > 15 and all(len(b.column("docs")[0]) <= 7 for b in shards)
    found = S.Index(stage.write(spark.createDataFrame([r for b in shards for r in b.to_pylist()], S.INDEX), "small"), n, size)
    items = [(i, docs[i][1]) for i in range(10)]
    got = [tuple(r) for r in S.search(stage, found, _items(spark, items), 9).collect()]
    assert sorted(got, key=str) == sorted(_plain(docs, items, 9), key=str)


def test_odd_documents(spark, make_docs, odd_rows):
    docs = [(d, t) for d, t, *_ in odd_rows]
    _same(spark, make_docs, docs, [(1, "alpha"), (2, "word one"), (3, "été ﬁne"), (4, "p1 p2 tail"), (5, "y" * 30_000)])


def test_empty_tables(spark, make_docs):
    assert _same(spark, make_docs, [], [(1, "a")]) == []
    assert _same(spark, make_docs, [(1, "a b")], []) == []
    assert _same(spark, make_docs, [(1, None), (2, "--")], [(1, "a")]) == []


def test_best_first_leaves_most_nodes(monkeypatch):
    """A rare term's documents are reached without opening the others' nodes."""
    n = 2048
    texts = [[b"common", b"rare"] if i == 777 else [b"common"] for i in range(n)]
    columns = S.build(list(range(n)), [w for t in texts for w in t], [1] * (n + 1), [len(t) for t in texts], [len(t) for t in texts], n, n + 1)
    shard = S.Shard(n, columns[1], S.np.array(columns[2]), *columns[3:])
    opened = []
    real = shard.ones
    monkeypatch.setattr(shard, "ones", lambda level, at: opened.append(len(level)) or real(level, at))
    scores, numbers = shard.best([("common", 1), ("rare", 9000)], 1, 1)
    assert numbers.tolist() == [777] and sum(opened) / 2 < n / 2


def test_row_groups_of_the_index_are_few_shards(spark, monkeypatch):
    """Parquet's own look at its size after 100 rows would put all shards of a task into one row group."""
    import glob

    import pyarrow.parquet as pq
    from oathmill.llm import lexical_search as L
    from oathmill.llm.shared import Stage

    monkeypatch.setitem(L._GROUPS, "parquet.block.size", 1024)
    stage = Stage(spark, "groups")
    L.index(stage, spark.range(0, 3 * L.SHARD_DOCS, 1, 1).selectExpr("id AS doc_id", "concat('w', id) AS text"))
    files = [pq.ParquetFile(f) for f in glob.glob(f"{stage.root}/index/*.parquet")]
    assert sum(f.metadata.num_rows for f in files) == sum(f.num_row_groups for f in files) == 3
