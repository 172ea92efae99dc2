from __future__ import annotations

import re
from collections import Counter

from oathmill.llm import quality_rules as Q
from oathmill.llm.shared import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def bucket(v):
    s = max(0, v.bit_length() - 11)
    return v if v < 2048 else s * 1024 + (v >> s)


def top(b):
    s = max(0, (b - 1024) // 1024)
    return b if b < 2048 else ((b - s * 1024 + 1) << s) - 1


def middle(values):
    b = sorted(map(bucket, values))
    at = lambda q: top(next(x for i, x in enumerate(b) if (i + 1) * 100 >= q * len(b)))
    return at(50), max(1, at(50) - at(25))


def fence(own, lang, every):
    """The fence of one ratio from the values of the group, its language and all documents."""
    shrink = lambda n, a, b: tuple((n * x + 200 * y) // (n + 200) for x, y in zip(a, b, strict=True))
    mid2, spread2 = shrink(len(lang), middle(lang), middle(every))
    mid, spread = shrink(len(own), middle(own), (mid2, spread2))
    wide = mid2 + 12 * spread2
    return mid + 12 * min(spread, 2 * spread2) if mid <= wide else wide


def test_counts_on_odd_rows(spark, make_docs, odd_rows):
    got = sorted((str(r["doc_id"]), *(r[c] for c in Q.COUNTS), r["base_failed"]) for r in Q.judge(spark, make_docs(odd_rows)).collect())
    want = sorted((str(d), *(b := brute(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for d, t, _, _ in odd_rows)
    assert got == want
    assert Q.judge(spark, make_docs([])).count() == 0


def ratios(text):
    text = text or ""
    n, chars, *_ = brute(text)
    count = lambda kind: len(re.findall(kind, text))
    return 1000 * count(r"[!-/:-@\[-`{-~]") // max(1, chars), 1000 * chars // max(1, n), 1000 * count("[A-Z]") // max(1, count("[A-Za-z]"))


def check_verdicts(rows, texts):
    groups, langs, cuts = {}, {}, {}
    for r in rows:
        groups.setdefault((r["lang"], r["source"]), []).append(r)
        langs.setdefault(r["lang"], []).append(r)
    for (lang, source), own in groups.items():
        cuts[lang, source] = [fence([x[m] for x in own], [x[m] for x in langs[lang]], [x[m] for x in rows]) for m in Q.RATIOS]
    for r in rows:
        text = texts[r["doc_id"]]
        assert tuple(r[c] for c in Q.COUNTS) == brute(text) and tuple(r[m] for m in Q.RATIOS) == ratios(text)
        assert [r[f"cut_{m}"] for m in Q.RATIOS] == cuts[r["lang"], r["source"]]
        assert r["kept"] == (not r["base_failed"] and all(r[m] <= r[f"cut_{m}"] for m in Q.RATIOS))
    return cuts


def test_cutoffs_and_verdicts_against_brute_force(spark, sf):
    rows = Q.judge(spark, documents(spark, sf)).collect()
    check_verdicts(rows, {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()})


def test_groups_have_fences_of_their_own_and_junk_sources_those_of_their_language(spark, make_docs):
    plain = lambda i, k: " ".join(f"{'abcde'[(i + j) % 5] * (k + (i * j) % 3)}{chr(97 + j % 26)}{'xy'[j // 26]}" for j in range(40)) + "."
    junk = " ".join(f"###{chr(97 + j)}" for j in range(26))
    rows = [(i, plain(i, 3), "en", "short") for i in range(300)] + [(1000 + i, plain(i, 9), "en", "long") for i in range(300)]
    rows += [(2000 + i, plain(i, 3), "en", "other") for i in range(900)] + [(4000 + i, plain(i, 3) if i % 4 == 0 else junk, "en", "junk") for i in range(200)]
    found = Q.judge(spark, make_docs(rows)).collect()
    cuts = check_verdicts(found, {d: t for d, t, *_ in rows})
    assert cuts["en", "short"][1] != cuts["en", "long"][1]
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not any(kept[4000 + i] for i in range(200) if i % 4) and all(kept[i] for i in [*range(300), *range(1000, 1300), *range(2000, 2900), *range(4000, 4200, 4)])
    assert not any(r["base_failed"] for r in found)


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    rows = Q.judge(spark, documents(spark, folder)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept", "n_words").where("n_words >= 20").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_query_against_its_sql(spark, duck, sf):
    from compare import rows_of
    from oathmill.llm import queries

    assert rows_of(queries.op2_quality_rules(spark, sf).toPandas()) == rows_of(duck.execute(queries.oracle_sql()["op2_quality_rules"]).fetchdf())
