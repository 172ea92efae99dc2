from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from oathmill.llm import vector_codes as V

ROWS = "vec_id long, embedding array<float>, label int, v string, entry string, code string, name string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, e, la, "x", "x", "x", "x") for i, e, la in rows], ROWS)


def _plain(rows):
    """All distances, loops and Python's whole numbers."""
    kept = sorted(((i, [math.floor(4096 * float(np.float32(x))) for x in e], la) for i, e, la in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    parts = [[v[p * w : p * w + w] for _, v, _ in kept] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            own = [near(p, x)[1] for x in parts[p]]
            for j in range(len(books[p])):
                mine = [x for x, o in zip(parts[p], own, strict=True) if o == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[near(p, x) for x in parts[p]] for p in range(8)]
    errors = [sum(final[p][n][0] for p in range(8)) for n in range(len(kept))]
    label = {}
    for (_, _, la), e in zip(kept, errors, strict=True):
        label[la] = label.get(la, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{final[p][n][1]:02x}" for p in range(8)), errors[n], label[la], sha) for n, (i, _, la) in enumerate(kept)]


def _rows(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, width))
    rows = [(i, (centres[rng.integers(24)] + 0.2 * rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(3)) if i % 7 else None) for i in range(n)]
    bad = [float("nan"), float("inf"), None]
    return rows + [(n + k, [b] + rows[0][1][1:], 1) for k, b in enumerate(bad)] + [(n + 4, None, 1), rows[5], rows[5], (None, rows[9][1], 2)]


def _same(spark, rows):
    got = sorted(map(tuple, V.codes(spark, _frame(spark, rows)).collect()), key=str)
    assert got == sorted(_plain(rows), key=str)
    return got


def test_codes_equal_a_plain_run_with_nulls_repeats_and_clashing_names(spark):
    assert len(_same(spark, _rows(300))) == 303


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_rows_than_entries(spark, n):
    _same(spark, [(i, [0.25 * ((i * 3 + k) % 5 - 2) for k in range(8)], None) for i in range(n)])


def test_ties_and_equal_vectors_go_to_the_lower_index(spark):
    grid = [(i, [((i >> (k % 4)) & 1) - 0.5 for k in range(8)], i % 2) for i in range(64)]
    codes = _same(spark, grid + [(100 + i, [0.0] * 8, 3) for i in range(40)])
    assert {r[1] for r in codes if r[0] >= 100} != set()


def test_empty_table_and_wrong_lengths(spark):
    assert V.codes(spark, _frame(spark, [])).count() == 0
    assert V.codes(spark, _frame(spark, [(1, None, 1), (2, [None] * 8, 2)])).count() == 0
    with pytest.raises(ValueError, match="multiple of 8"):
        V.codes(spark, _frame(spark, [(1, [1.0] * 9, 1)])).count()


def test_bounds_spare_distances_and_change_nothing():
    """Rounds with bounds give the entries of full searches and take far fewer distances."""
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(16, 8))[rng.integers(16, size=4000)] * 4096 + rng.normal(size=(4000, 8)) * 300).astype(np.int64)
    book, entry = x[:16].copy(), np.zeros(4000, np.int64)
    upper, lower, spent = np.full(4000, np.inf, np.float32), np.zeros((4000, 16), np.float32), []
    for _ in range(5):
        entry, upper, lower, work = V.assign(x, book, entry, upper, lower)
        spent.append(work.sum())
        true = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == true.argmin(axis=1)).all() and (upper**2 * (1 + 1e-6) >= true.min(axis=1)).all() and (lower.astype(float) ** 2 <= true * (1 + 1e-9)).all()
        after = np.array([x[entry == j].sum(axis=0) // max(1, (entry == j).sum()) if (entry == j).any() else book[j] for j in range(16)])
        moved = np.sqrt(((after - book) ** 2).sum(axis=1).astype(float))
        upper, lower, book = V._up(upper + moved[entry]), V._down(lower.astype(float) - moved), after
    assert spent[-1] < spent[0] / 4
