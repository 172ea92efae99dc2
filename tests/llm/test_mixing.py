from __future__ import annotations

import struct

import numpy as np
import pytest
import xxhash

from oathmill.llm import mixing as M
from oathmill.llm.shared import Stage, documents


def goals(sizes):
    """Targets by the level at which water stands in tubs of width weight and depth 3 * size / weight."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    tubs = [(s, i % 3 + 1, 3 * sizes[s]) for i, s in enumerate(names)]
    left, out = sum(sizes.values()), {}
    for i, (s, w, most) in enumerate(sorted(tubs, key=lambda t: t[2] / t[1])):
        rest = sum(t[1] for t in sorted(tubs, key=lambda t: t[2] / t[1])[i:])
        out[s] = min(most, w * left / rest)
        left -= out[s]
    return out


def test_targets_share_and_stop(spark):
    def got(sizes):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
        return {r["source"]: r["target"] for r in M.targets(Stage(spark, "t"), rows).collect()}

    assert got({"b": 100, "a": 5, None: 50, "c": 40}) == pytest.approx({"a": 15, "b": 60, "c": 90, None: 30})
    assert got({"a": 1, "b": 1}) == pytest.approx({"a": 2 / 3, "b": 4 / 3}) and got({"a": 1, "b": 100}) == pytest.approx({"a": 3, "b": 98})
    assert got({}) == {} and got({"a": 0}) == {"a": 0.0}
    rng = np.random.default_rng(3)
    many = {f"s{k}\u00e9{chr(int(c))}": int(n) for k, (c, n) in enumerate(zip(rng.integers(65, 900, 300), rng.integers(0, 10**6, 300) ** 2 // 10**6, strict=True))} | {None: 7}
    assert got(many) == pytest.approx(goals(many))


def test_pivot_keeps_words_and_is_unbiased():
    rng = np.random.default_rng(0)
    taken = np.zeros(40)
    for trial in range(1500):
        keys = [int(k) for k in rng.integers(0, 2**62, 40)]
        units = [(k, 0.3, int(w)) for k, w in zip(keys, np.arange(1, 41) * 7, strict=True)]
        done, held = M.pivot(units, trial % 5)
        words = {k: w for k, _, w in units}
        total = sum(u * words[k] for k, u in done) + (held[1] * held[2] if held else 0)
        assert total == pytest.approx(sum(p * w for _, p, w in units)) and len(done) + bool(held) == 40
        for k, u in done:
            taken[keys.index(k)] += u
        if held:
            taken[keys.index(held[0])] += held[1]
    assert np.abs(taken / 1500 - 0.3).max() < 0.06


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    goal = goals({s: sum(r["size"] for r in g) for s, g in by.items()})
    for s, g in by.items():
        assert all(r["target"] == pytest.approx(goal[s]) and r["source_size"] == sum(x["size"] for x in g) for r in g)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in g)
        assert abs(sum(r["taken"] for r in g) - goal[s]) <= max(r["size"] for r in g)


def test_odd_rows_and_tables(spark, make_docs, odd_rows, sf, monkeypatch):
    rows = M.mix(spark, make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    check(rows)
    assert M.mix(spark, make_docs([])).count() == 0
    monkeypatch.setattr(M, "BUCKET_UNITS", 4)
    monkeypatch.setattr(M, "FAN_IN", 3)  # several levels
    docs = documents(spark, sf)
    first = M.mix(spark, docs).collect()
    check(first)
    again = M.mix(spark, docs.repartition(7)).collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(first) == key(again)


def xx(value, kind, seed):
    return xxhash.xxh64_intdigest(struct.pack(kind, value), seed)


def tree(rows, units_of_bucket, fan_in):
    """A plain rounding tree over (source, doc_id, size, twins, rate, key): how many of the twins go up."""
    more = {r: int(r[3] * (r[4] - int(r[4])) + 1e-9) for r in rows}
    n = max(1, -(-len(rows) // units_of_bucket))
    live = [(r[5] % n, r, r[3] * (r[4] - int(r[4])) - more[r]) for r in rows if r[2] > 0 and r[3] * (r[4] - int(r[4])) - more[r] > 1e-9]
    level = 0
    while True:
        last = fan_in**level >= n
        cells = {}
        for bucket, r, p in live:
            cells.setdefault((bucket, r[0]), []).append((r, p))
        live = []
        for (bucket, _), cell in cells.items():
            cell.sort(key=lambda u: (signed(xx(level, "<i", xx(u[0][5], "<q", 42))), u[0][5]))
            open_, p_open = None, 0.0
            for r, p in cell:
                if open_ is None:
                    open_, p_open = r, p
                    continue
                wa, wb = open_[2], r[2]
                gain, loss = min(wa - p_open * wa, p * wb), min(p_open * wa, wb - p * wb)
                draw = M.uniform(open_[5] ^ (r[5] * 0x9E3779B97F4A7C15), level)
                moved = gain if draw * (gain + loss) < loss else -loss
                both = [(open_, p_open + moved / wa), (r, p - moved / wb)]
                open_ = None
                for x, q in both:
                    if q >= 1 - 1e-9:
                        more[x] += 1
                    elif q > 1e-9:
                        open_, p_open = x, q
            if open_ is not None:
                if last:
                    more[open_] += M.uniform(open_[5], 99) < p_open
                else:
                    live.append((bucket // fan_in, open_, p_open))
        if last:
            return more
        level += 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("fan_in", [3, 256])
def test_every_document_against_a_second_tree(spark, sf, monkeypatch, fan_in):
    monkeypatch.setattr(M, "BUCKET_UNITS", 4)
    monkeypatch.setattr(M, "FAN_IN", fan_in)
    docs = documents(spark, sf)
    docs = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.where("doc_id % 27 = 0"))
    got = {}
    for r in M.mix(spark, docs).collect():
        got.setdefault((r["source"], r["doc_id"], r["size"], r["target"] / r["source_size"] if r["source_size"] else 0.0, r["key"]), []).append(r["copies"])
    more = tree([(s, d, n, len(c), rate, key) for (s, d, n, rate, key), c in got.items()], 4, fan_in)
    for (s, d, n, rate, key), copies in got.items():
        assert sum(copies) == (len(copies) * int(rate) + more[s, d, n, len(copies), rate, key] if n else 0)


def test_equal_rows_and_equal_hashes(spark, make_docs, monkeypatch):
    rows = [(1, "a b c", "en", "x")] * 1000 + [(2, "d e", "en", "y")] * 10 + [(i, "f g h i", "en", "z") for i in range(3, 40)]
    check(M.mix(spark, make_docs(rows)).collect())
    monkeypatch.setattr(M.F, "xxhash64", lambda *c: M.F.lit(11).cast("long"))
    found = M.mix(spark, make_docs(rows)).collect()
    assert len(found) == len(rows)
    check(found)
