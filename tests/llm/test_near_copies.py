from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from oathmill.llm import near_copies as N
from oathmill.llm import stages
from oathmill.llm.shared import documents
from test_simhash import brute_print

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def jaccard(a, b):
    return len(a & b) / (len(a | b) or 1)


def brute_groups(rows):
    """Group number of each (doc_id, text), by all pairs: op7's three bits, or similarity 0.8 over five-word shingles."""
    group, sets, prints = list(range(len(rows))), [brute_set(t) for _, t in rows], [brute_print(t) for _, t in rows]

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or jaccard(sets[i], sets[j]) >= 0.8:
                group[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def survivors(rows):
    """The smallest doc_id of each group; rows without nulls and with one row per doc_id."""
    low = {}
    for (d, _), g in zip(rows, brute_groups(rows), strict=True):
        low[g] = min(low.get(g, d), d)
    return sorted(low.values())


def edited(rng, words, share):
    """About so many of the words replaced."""
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_sets_are_those_of_the_words():
    for text in ("", " \n", "One", "a b c d", "A b c d e", "a b c d e f a b c d e f", "漢字 é É " * 4):
        assert len(N.shingles(text.encode())) == len(brute_set(text))
    assert list(N.shingles(b"A B c d e f")) == list(N.shingles(b"a b\nc  d e f")) != list(N.shingles(b"b a c d e f"))


def test_long_texts_hash_alike_in_chunks(monkeypatch):
    found = N.shingles(" ".join(f"w{i * i % 9973}" for i in range(9000)).encode())
    want = N.block_keys(found)
    monkeypatch.setattr(N, "CHUNK", 10**6)
    assert list(N.block_keys(found)) == list(want) and len(set(want)) == N.BLOCKS


@pytest.mark.parametrize("hot", [3, 10_000])
def test_groups_of_edited_copies(spark, make_docs, monkeypatch, hot):
    """Copies at all distances, chains whose ends are unlike, and texts that share half their words, against all pairs."""
    monkeypatch.setattr(N, "HOT_KEY", hot)
    rng, rows = random.Random(hot), []
    common = [f"common{i}" for i in range(120)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(200)]
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.1]))) for _ in range(12)]
        rows += [" ".join(common + base[i : i + 90]) for i in range(0, 100, 45)]
    chain = [f"c{i}" for i in range(240)]
    rows += [" ".join(chain[i : i + 150]) for i in range(0, 90, 6)]
    rows = list(zip(rng.sample(range(1000), len(rows)), rows, strict=True))
    out = stages.drop_near_duplicates(spark, make_docs([(d, t, "en", "s") for d, t in rows]), "")
    want = survivors(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == want and 20 < len(want) < 70


def test_components_of_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    assert sorted(r["doc_id"] for r in stages.drop_near_duplicates(spark, documents(spark, sf), "").collect()) == survivors(rows)


def test_odd_rows(spark, make_docs, odd_rows):
    """Texts without words are one group; a null doc_id stays only where its group has no other."""
    kept = stages.drop_near_duplicates(spark, make_docs(odd_rows), "").collect()
    rows = [(10**6 if d is None else d, t) for d, t, *_ in odd_rows]
    assert sorted(r["doc_id"] for r in kept) == survivors(rows)
    lone = stages.drop_near_duplicates(spark, make_docs([(None, "a b c d e f g", None, None), (None, "q r s t u v w x", None, None)] * 2), "").collect()
    assert [r["doc_id"] for r in lone] == [None, None]
    assert stages.drop_near_duplicates(spark, make_docs([]), "").count() == 0


def test_no_block_meets_itself_whole(spark, make_docs, monkeypatch):
    """600 near copies, few of them apart: the pairs that are verified grow with the texts, not with their square."""
    rng, base, met, plain = random.Random(1), [f"w{i}" for i in range(150)], [], N.verified
    rows = [(d, " ".join(edited(rng, base, 0.01))) for d in range(600)]
    monkeypatch.setattr(N, "verified", lambda docs, nodes, pairs: met.append(pairs.count()) or plain(docs, nodes, pairs))
    kept = stages.drop_near_duplicates(spark, make_docs([(d, t, "en", "s") for d, t in rows]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == survivors(rows) and met[0] < 600 and sum(met) < 600 * 600 / 10


def test_sets_of_a_hot_block_meet_without_another_block(spark, make_docs, monkeypatch):
    """All sets share one block and no other: those at 0.8 link all the same, also in a block of more than HOT_KEY sets."""
    monkeypatch.setattr(N, "HOT_KEY", 3)
    plain, rng, rows = N.sketches, random.Random(5), []
    monkeypatch.setattr(N, "sketches", lambda docs: plain(docs).withColumn("keys", F.when(F.size("keys") > 0, F.array(F.lit(1).cast("long"))).otherwise(F.col("keys"))))
    for g in range(5):
        base = [f"g{g}w{i}" for i in range(150)]
        rows += [" ".join(base[i:] + [f"g{g}end{j}" for j in range(i)]) for i in (0, 8, 16, 24, 32)]
    rows = list(zip(rng.sample(range(1000), len(rows)), rows, strict=True))
    kept = stages.drop_near_duplicates(spark, make_docs([(d, t, "en", "s") for d, t in rows]), "").collect()
    assert sorted(r["doc_id"] for r in kept) == survivors(rows) and len(survivors(rows)) < 25


def test_two_large_groups_below_the_similarity_do_not_meet_pair_by_pair(spark, make_docs, monkeypatch):
    """Two groups share two hot blocks and most of their words, and their differences occur many times: no set of one meets each of the other's."""
    monkeypatch.setattr(N, "HOT_KEY", 8)
    plain, across, met = N.sketches, N._across, []
    two = F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    monkeypatch.setattr(N, "sketches", lambda docs: plain(docs).withColumn("keys", F.when(F.size("keys") > 0, two).otherwise(F.col("keys"))))

    def counted(*args):
        out = across(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(N, "_across", counted)
    base = [f"w{i}" for i in range(120)]
    rows = [(40 * g + i, " ".join([*base, *[f"g{g}end{j}" for j in range(24)], f"own{g}x{i}"])) for g in range(2) for i in range(40)]
    edge = [*base, *[f"g0end{j}" for j in range(10)]]
    rows += [(100 + i, " ".join([*edge, *[f"edge{i}x{j}" for j in range(n)]])) for i, n in enumerate((12, 16, 20, 24))]
    kept = stages.drop_near_duplicates(spark, make_docs([(d, t, "en", "s") for d, t in rows]), "").collect()
    want = survivors(rows)
    assert sorted(r["doc_id"] for r in kept) == want and {0, 40} <= set(want) and sum(met) < 84
