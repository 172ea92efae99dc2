from __future__ import annotations

import hashlib

import numpy as np

from oathmill.llm import phrases as P
from oathmill.llm.shared import documents


MASK = 2**64 - 1
ODD = 0x9E3779B97F4A7C15


def _mixed(x):
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
    return x ^ (x >> 32)


def _tossed(items, width):
    """Labels of items: twice the lowest bit in which one differs from the one before (the first: from its complement), plus that bit."""
    out = []
    for i, x in enumerate(items):
        y = items[i - 1] if i else ~x & ((1 << width) - 1)
        differ = x ^ y
        k = (differ & -differ).bit_length() - 1 if differ else 0
        out.append(2 * k + (x >> k & 1))
    return out


def parsed(text):
    """Fingerprint of one text in Python's own numbers: (root, sample), by loops over items."""
    symbols, names, kept, level = list(text), [_mixed((b + 1) * ODD & MASK) for b in text], set(), 0
    if not text:
        return 0, []
    while True:
        level += 1
        runs = []  # [symbol, name, how often]
        for x, n in zip(symbols, names, strict=True):
            if runs and runs[-1][0] == x:
                runs[-1][2] += 1
            else:
                runs.append([x, n, 1])
        items = [r[0] for r in runs]
        named = [r[1] if r[2] == 1 else _mixed((r[1] + r[2] * ODD) & MASK) for r in runs]
        labels = _tossed(items, 8 if level == 1 else 64)
        for _ in range(2 if level == 1 else 3):
            labels = _tossed(labels, 8)
        begins = [0] + [i for i in range(1, len(items) - 1) if labels[i - 1] > labels[i] < labels[i + 1]]
        phrases = []
        for a, b in zip(begins, begins[1:] + [len(items)], strict=True):
            phrases.append(_mixed((sum(n * pow(ODD, i, 2**64) for i, n in enumerate(named[a:b])) + b - a) & MASK))
        if level >= P.FROM or len(phrases) == 1:
            kept |= {n >> 32 for n in phrases}
        if len(phrases) == 1:
            return phrases[0], sorted(kept)[: P.SKETCH]
        symbols = names = phrases


def alike(a, b):
    if a == b:
        return 1.0
    low = sorted({*a[1], *b[1]})[: P.SKETCH]
    return sum(v in a[1] and v in b[1] for v in low) / len(low) if low else 0.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (P.LEAST_ID if r[0] is None else r[0]) * -1 if r[0] != 0 else 0)
    rows.sort(key=lambda r: r[1] if r[1] is not None else "")
    rows.sort(key=lambda r: -(P.LEAST_ID if r[0] is None else r[0]))
    out = []
    for (d, t, *_), (_, u, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = (parsed(x.encode()) for x in (t, e, u))
        shown = lambda f: f"{f[0]:016x}" + "".join(f"{v:08x}" for v in f[1])
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c)))
    return sorted(out, key=str)


def test_all_rows_against_brute_force(spark, make_docs, odd_rows, sf):
    got = sorted((tuple(r) for r in P.fingerprint_documents(spark, make_docs(odd_rows)).collect()), key=str)
    assert got == brute(odd_rows)
    docs = documents(spark, sf).repartition(3)
    assert sorted((tuple(r) for r in P.fingerprint_documents(spark, docs).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert P.fingerprint_documents(spark, make_docs([])).count() == 0
    one = make_docs([(5, "only one document here", "en", "a")])
    assert P.fingerprint_documents(spark, one).first()["near_next"] == 1.0


def test_equal_substrings_share_interior_names():
    rng = np.random.default_rng(1)
    middle = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) + middle for n in (0, 1, 7, 13)]
    names = []
    for t in texts:
        x = np.frombuffer(t, np.uint8)
        with np.errstate(over="ignore"):
            n1, d1 = P._parse(x, P._BYTE_NAMES[x], np.zeros(len(x), np.int32))
            n2, _ = P._parse(n1, n1, d1)
        names.append(set(n2.tolist()))
    assert all(len(names[0] & n) > 0.95 * len(names[0]) for n in names[1:])


def test_batches_do_not_change_fingerprints():
    texts = [b"", b"a", b"aaaa" * 50, b"abc" * 400, "été ".encode() * 90, bytes(range(256)) * 4]
    together = [P.shown(f) for f in P.fingerprints(texts)]
    assert together == [P.shown(P.fingerprints([t])[0]) for t in texts] and len(set(together)) == len(texts)
    f = P.fingerprints([b"", b"", b"abc def"])
    assert P.likeness(f[0], f[1]) == 1.0 and P.likeness(f[0], f[2]) == 0.0


def test_likeness_follows_what_is_shared(spark):
    texts = [r["text"] for r in documents(spark, "/root/testdata/sf0.01").where("n_chars > 1500").limit(60).collect()]
    a = P.fingerprints([t.encode() for t in texts])
    half = P.fingerprints([P.edited(t, u).encode() for t, u in zip(texts, texts[1:] + texts[:1], strict=True)])
    near = [P.likeness(x, y) for x, y in zip(a, half, strict=True)]
    far = [P.likeness(x, y) for x, y in zip(a, a[1:] + a[:1], strict=True)]
    assert 0.2 < np.median(near) < 0.6 and np.median(far) < 0.1
