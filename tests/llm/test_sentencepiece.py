from __future__ import annotations

import hashlib
import random
import struct

import pytest
import sentencepiece

from oathmill.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def encoder():
    return S.opened(open(S.MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def test_ids_are_the_librarys(encoder, library):
    random.seed(7)
    bits = ["the", "tion", " ", "  ", "▁", "\n", "\t", "é", "ñ", "漢", "字", "\U0001F600", "12", "x", ".,", "ing", "Ｆ", "      "]
    texts = ["".join(random.choices(bits, k=random.randint(0, 40))) for _ in range(1500)] + ["", " ", " " * 50, "x" * 400, "the" * 500, "aaaa" * 99 + " b"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t)
        assert encoder.decode(ids) == t.replace("▁", " ")


def test_paths_commit_in_a_bounded_window(encoder, library):
    text = "thetioningabcéx漢" * 3000  # no space: one run
    stream = encoder.viterbi(["▁", text])
    first = [next(stream) for _ in range(5)]
    assert first == library.encode(text)[:5]
    assert first + list(stream) == library.encode(text)


def test_slices_do_not_change_ids(encoder, library, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 7)
    random.seed(5)
    for _ in range(200):
        t = "".join(random.choices(["the", "tion", " ", "▁", "\n", "é", "漢", "\U0001F600", "ing", "  ", "Ｆx"], k=random.randint(0, 60)))
        ids = encoder.encode(t)
        assert ids == library.encode(t) and list(encoder.viterbi(["▁", *t.replace(" ", "▁")])) == (ids if t else list(encoder.viterbi(["▁"])))
        assert S._with_digests(encoder, t)["round_trip"]


def test_a_run_of_five_megabytes_holds_a_bounded_state(encoder):
    words = random.Random(2).choices(["thetion", "abc", "éx", "漢", "ing", "q", "Zz9", "\U0001F600"], k=200_000)
    run = "".join(words)
    text = run * (5_000_000 // len(run.encode()) + 1)
    assert len(text.encode()) >= 5_000_000 and " " not in text
    search = encoder.viterbi(text[i : i + S.SLICE] for i in range(0, len(text), S.SLICE))
    out, n, states, held = bytearray(), 0, 0, 0
    for n, i in enumerate(search, 1):
        out += encoder.model.out[i]
        if n % 5_000 == 1:
            now = search.gi_frame.f_locals
            states, held = max(states, len(now["piece"])), max(held, len(now["text"]))
    assert n > 500_000 and out.decode() == text
    assert states <= 5 * encoder.model.longest and held <= S.SLICE + 5 * encoder.model.longest


def _model(pieces, kind):
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    raw = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    return raw + field(2, bytes([3 << 3, kind])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))


def test_unigram_models_take_the_best_sum(monkeypatch):
    random.seed(3)
    pieces = [("<unk>", 0.0, 2)] + [(p, -random.uniform(1, 9), 1) for p in ["▁", "a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cab", "bca"]]
    enc = S.Encoder(S.Model(_model(pieces, 1)))
    score = {p: s for p, s, k in pieces if k == 1}

    def brute(text):
        best = {0: (0.0, [])}
        for i in range(1, len(text) + 1):
            options = [(best[j][0] + score[text[j:i]], best[j][1] + [text[j:i]]) for j in range(i) if text[j:i] in score]
            best[i] = max(options, key=lambda o: o[0])
        return best[len(text)]

    for n in range(60):
        text = "".join(random.choices("abc ", k=random.randint(1, 120)))
        monkeypatch.setattr(S, "SLICE", 5 if n % 2 else 65_536)
        ids = enc.encode(text)
        got = sum(enc.model.scores[i] for i in ids)
        assert got == pytest.approx(brute("▁" + text.replace(" ", "▁"))[0]) and enc.decode(ids) == text


def test_every_row_is_encoded(spark, make_docs, odd_rows, library):
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in S.digests(spark, make_docs(odd_rows)).collect()), key=str)
    import numpy as np

    want = sorted(((d, len(ids := library.encode(t or "")), hashlib.sha256(np.array(ids, dtype="<i4").tobytes()).hexdigest(), True) for d, t, _, _ in odd_rows), key=str)
    assert got == want
    assert S.digests(spark, make_docs([])).count() == 0
    back = S.decode(spark, S.encode(spark, make_docs(odd_rows)))
    assert sorted(map(str, [tuple(r) for r in back.collect()])) == sorted(str((d, t or "")) for d, t, _, _ in odd_rows)
