from __future__ import annotations

import random
import re

import pytest
import xxhash

from oathmill.llm import simhash as H
from oathmill.llm.shared import Stage, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(prints):
    """prints: (doc_id, fingerprint) -> component of each row, by all pairs."""
    ids = list(range(len(prints)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                ids[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check(spark, rows, docs):
    prints = [(d, brute_print(t)) for d, t, *_ in rows]
    want = sorted(((d, signed(p), c) for (d, p), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert sorted((tuple(r) for r in H.near_duplicates(spark, docs).collect()), key=str) == want


def test_odd_rows(spark, make_docs, odd_rows):
    check(spark, odd_rows, make_docs(odd_rows))
    assert H.near_duplicates(spark, make_docs([])).count() == 0


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    check(spark, rows, documents(spark, sf))


@pytest.mark.parametrize("hot", [4, 10_000])
def test_pairs_of_clouds(spark, monkeypatch, hot):
    """Chains and clouds of near fingerprints, with and without the finer split of hot keys."""
    monkeypatch.setattr(H, "HOT_KEY", hot)
    random.seed(hot)
    prints = set()
    for _ in range(4):
        x = random.getrandbits(64)
        for _ in range(50):
            prints.add(x)
            for b in random.sample(range(64), random.randint(1, 4)):
                x ^= 1 << b
    center = random.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in random.sample(range(20), random.randint(0, 3))) for _ in range(80)}
    prints = sorted(map(signed, prints))
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    stage = Stage(spark, "t")
    pairs = H.links(stage, nodes)
    assert {tuple(r) for r in pairs.collect()} == want
    roots = {r["node"]: r["root"] for r in H.components(stage, pairs).collect()}
    marks = {p: p for p in prints}
    for _ in prints:
        for a, b in want:
            marks[a] = marks[b] = min(marks[a], marks[b])
    assert all(roots.get(p, p) == marks[p] for p in prints)


def test_components_of_a_long_chain_are_whole(spark):
    """A chain takes many turns; none is left half done."""
    random.seed(4)
    nodes = random.sample(range(10**6), 3000)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(nodes, nodes[1:], strict=False)] + [(10**7, 10**7 + i) for i in range(1, 500)], "u long, v long")
    roots = {r["node"]: r["root"] for r in H.components(Stage(spark, "t"), pairs).collect()}
    assert roots == {n: min(nodes) for n in nodes} | {10**7 + i: 10**7 for i in range(500)}
