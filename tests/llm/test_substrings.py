from __future__ import annotations

import hashlib
import random
import re

import pytest

from compare import rows_of
from oathmill.llm import queries
from oathmill.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - 12) for k in range(13) if d is not None and first[tuple(w[i : i + 13])] < d}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_odd_rows_against_brute_force(spark, make_docs, odd_rows):
    rows = odd_rows + [(20, "word " * 30, "en", "a"), (21, " ".join(f"p{i}" for i in range(5, 18)), "en", "a"), (22, " ".join(f"p{i}" for i in range(5, 17)), "en", "a")]
    assert collected(S.removal_digests(spark, make_docs(rows))) == brute(rows)
    assert S.removal_digests(spark, make_docs([])).count() == 0


@pytest.mark.parametrize("batches", [1, 6])
def test_random_mixtures_against_brute_force(spark, make_docs, monkeypatch, batches):
    monkeypatch.setattr(S, "BATCHES", batches)
    random.seed(batches)
    passages = [[random.choice("abcdefgh") + random.choice("xyz") for _ in range(random.randint(10, 40))] for _ in range(12)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(random.randint(0, 5)):
            p = random.choice(passages)
            a = random.randint(0, len(p) - 1)
            w += p[a : random.randint(a, len(p))] + [random.choice("abc") for _ in range(random.randint(0, 3))]
        rows.append((d, random.choice([" ", "\n", " \t "]).join(w), "en", "a"))
    assert collected(S.removal_digests(spark, make_docs(rows))) == brute(rows)


def test_index_takes_four_batches_in_four_calls(spark, tmp_path):
    """Each call opens the folder anew; runs are compacted, and joined as they lie."""
    from oathmill.llm.shared import Stage

    path, stage = f"file://{tmp_path}/index", Stage(spark, "t")
    levels, shared = [], []
    for d in range(4):
        index = S.FingerprintIndex(spark, path, 4)
        batch = spark.createDataFrame([(k, d) for k in range(100)] + [(1000 + d, d), (2000 + d, d), (2000 + d, 10 + d)], "key long, doc_id long")
        shared.append(sorted(r["key"] for r in index.add(batch, stage).collect()))
        levels.append(sorted(r["level"] for r in index.manifest["runs"]))
        index.close()
    assert shared == [[2000]] + [[*range(100), 2000 + d] for d in (1, 2, 3)]
    assert levels == [[0], [1], [0, 1], [2]]
    index = S.FingerprintIndex(spark, path)
    assert index.manifest["buckets"] == 4 and len(index.manifest["runs"]) == 1
    name = index.manifest["runs"][0]["name"]
    rows = {r["key"]: (r["first"], r["last"]) for r in index.run(name).collect()}
    assert rows == {k: (0, 3) for k in range(100)} | {1000 + d: (d, d) for d in range(4)} | {2000 + d: (d, 10 + d) for d in range(4)}
    new = index._write(spark.createDataFrame([(5, 9), (7777, 9)], "key long, doc_id long").groupBy("key").agg({"doc_id": "min"}).selectExpr("key", "`min(doc_id)` first", "`min(doc_id)` last"), 0)
    with index.merging():
        joined = index.probe(new)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert [r["key"] for r in joined.collect()] == [5]
    index.drop()
    assert not spark.catalog.listTables(pattern="run_*")


def text_batch(texts, **more):
    pa = S.pa
    columns = {"doc_id": pa.array(range(10, 10 + len(texts))), "salt": pa.array([1] * len(texts), pa.int16()), "th": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


ODD_TEXTS = [
    None, "", " \n ", "short one", " ".join(f"p{i}" for i in range(12)), " ".join(f"p{i}" for i in range(13)), "\t" + "\n\n".join(f"p{i}" for i in range(30)) + " ", "word " * 40,
    " ".join("é" * (i % 40) + str(i) for i in range(60)), " ".join("x" * i for i in range(1, 150)), " ".join("x" * i for i in range(1, 150)) + "y", "", " ".join(f"p{i}" for i in range(9, 40)), "p8\x00 " * 20,
]


@pytest.mark.parametrize("group", [1, 300, 262_144])
def test_stretches_of_a_batch_are_those_of_each_text(monkeypatch, group):
    """Texts cut together: none runs into the next, and every window lies in one stretch, under its own key."""
    monkeypatch.setattr(S, "GROUP_BYTES", group)
    found = [r for b in S._keys(iter([text_batch(ODD_TEXTS).slice(1, 0), text_batch(ODD_TEXTS)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(found) == len(set(found)) and {salt for *_, salt in found} == {1}
    by_doc = {d: [k for k, x, _ in found if x == d] for d in range(10, 10 + len(ODD_TEXTS))}
    wanted = S.pa.array(list(by_doc.values()), S.pa.list_(S.pa.int64()))
    windows, keys = {}, {}
    for b in S._stretched(iter([text_batch(ODD_TEXTS, wanted=wanted)])):
        for key, words, d, th, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = words.decode().split(" ")
            assert th == d - 10 and key in by_doc[d] and len(words) == n + 12
            for i in range(n):
                assert (d, at + i) not in windows
                windows[d, at + i] = tuple(words[i : i + 13])
                assert keys.setdefault(windows[d, at + i], key) == key
    split = {d: WORD.findall(t or "") for d, t in enumerate(ODD_TEXTS, 10)}
    assert windows == {(d, i): tuple(w[i : i + 13]) for d, w in split.items() for i in range(len(w) - 12)}
    some = S.pa.array([k[::2] for k in by_doc.values()], S.pa.list_(S.pa.int64()))
    few = [r for b in S._stretched(iter([text_batch(ODD_TEXTS, wanted=some).slice(3)])) for r in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), strict=True)]
    assert set(few) == {(d, k) for d, ks in by_doc.items() if d >= 13 for k in ks[::2]}


def test_words_are_hashed_together(monkeypatch):
    """A call for each word took a large part of op6's time; only words beyond LONG bytes have one."""
    calls, real = [], S.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(S.xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or real(w))
    made = list(S._keys(iter([text_batch([" ".join(f"w{i}" for i in range(3000)), "z" * 200 + " a" * 20])])))
    assert sum(b.num_rows for b in made) > 400 and calls == [b"z" * 200]


def test_words_that_differ_have_different_hashes():
    words = [b"x" * i + bytes([c]) for i in range(100) for c in b"abc\x00"] + [b"\x00" * i for i in range(1, 80)]
    words = list(dict.fromkeys(words))
    once, again = S.Words([b" ".join(words)]).hashes, S.Words([b"\n \t", b"\r\n".join(reversed(words))]).hashes
    assert len(set(once.tolist())) == len(words) and once.tolist() == again.tolist()[::-1]


def test_rows_that_repeat_share_their_spans(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage, "en", "a")] + [(2, passage + " end", "en", "a")] * 50
    assert collected(S.removal_digests(spark, make_docs(rows))) == brute(rows)
    _, spans = S.removal_spans(spark, make_docs(rows))
    found = spans.collect()
    assert len(found) == 1 and len(found[0]["spans"]) < 30


def test_five_thousand_texts_of_one_doc_id(spark, make_docs, monkeypatch):
    """What is gathered for a row does not grow with the rows of its doc_id."""
    passage = [f"p{i}" for i in range(40)]
    rows = [(1, " ".join(passage), "en", "a")] + [(2, " ".join([f"x{i}", *passage[i % 20 : i % 20 + 15], f"y{i}"]), "en", "a") for i in range(5000)] + [(3, " ".join(passage[5:25]), "en", "a")]
    sizes, real = [], S.Stage.write

    def write(self, df, name, *codec):
        out = real(self, df, name, *codec)
        if name == "wanted":
            sizes.append(out.selectExpr("max(size(wanted))").first()[0])
        return out

    monkeypatch.setattr(S.Stage, "write", write)
    assert collected(S.removal_digests(spark, make_docs(rows))) == brute(rows)
    assert sizes and sizes[0] <= 15 * 5  # a few texts of one part of the hash at most


def test_words_that_collide_in_one_hash_do_not_match(spark, make_docs, monkeypatch):
    """Two words with one first hash give different windows by the second."""
    batch = S.pa.RecordBatch.from_arrays([S.pa.array([1, 1]), S.pa.array([" ".join(["w"] * 12 + [x]).encode() for x in "ab"]), *(S.pa.array([0, 1]) for _ in range(3))], ["key", "words", "doc_id", "th", "at"])
    monkeypatch.setattr(S.xxhash, "xxh3_64_intdigest", lambda w: 7)
    made = next(S._windows(iter([batch])))
    assert len(set(made.column("window").to_pylist())) == 1 and len(set(made.column("again").to_pylist())) == 2


def test_stretches_with_one_hash_are_told_apart_by_their_words(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: S.F.lit(7).cast("long") if c == ("words",) else S.F.hash(*c).cast("long"))
    rows = [(d, " ".join(f"{'ab'[d % 2]}{i // 9}" for i in range(60)), "en", "a") for d in range(4)]
    assert collected(S.removal_digests(spark, make_docs(rows))) == brute(rows)


def test_white_space_of_kept_words_stays():
    text = "a\nb  " + " ".join(f"p{i}" for i in range(13)) + "\n\nc"
    assert S.without(text, (S.np.array([2]), S.np.array([1]))) == "a\nb  c" and S.without(text, None) == text


def test_query_against_its_sql(spark, duck, sf):
    assert rows_of(queries.op6_substring_dedup(spark, sf).toPandas()) == rows_of(duck.execute(queries.oracle_sql()["op6_substring_dedup"]).fetchdf())
