from __future__ import annotations

import random
import re

from oathmill.llm import license_scan as L
from oathmill.llm.shared import documents


LOW = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places, labels, spans = [], set(), []
    for number, (label, phrase) in enumerate(L.BASE + L.NOTICES):
        p = phrase.split()
        if number < len(L.BASE):
            hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        at = [[i for i in range(len(words) - 2) if words[i : i + 3] == p[t : t + 3]] for t in range(len(p) - 2)]
        for d in {i - t for t, found in enumerate(at) for i in found}:
            last, first, n = -1, None, 0
            for t, found in enumerate(at):
                after = [i for i in found if i > last and d <= i - t <= d + 4]
                if after:
                    last, n = min(after), n + 1
                    first = last if first is None else first
            spans.append((first, last + 3, n / len(at), label, number >= len(L.BASE)))
    said = set(labels)
    fits = sorted(s for s in spans if s[4] and s[2] >= 0.6)
    while fits:
        chain, end = [fits.pop(0)], 0
        end = chain[0][1]
        while fits and fits[0][0] < end:
            chain.append(fits.pop(0))
            end = max(end, chain[-1][1])
        best = max(s[2] for s in chain)
        said |= {s[3] for s in chain if s[2] == best}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(said)), max((s[2] for s in spans), default=0.0)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


CASES = [
    "Released UNDER the MIT License. Under the mit licence no.", "cc by nc cc-by-nc, CC BY\nNC by nc", "Licensed under the Apache License, Version 2.0", "apache license version 2 apache license version 2",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu really general public license version 3", "under the mit", "under the mıt license été", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software",
    "licensed under " * 2000 + "cc by nc",
    "licensed under the under the gnu the gnu general gnu general public general public license public license version license version 3",
    "cc0 licensed under the gnu general public license version 2 or licensed under the gnu lesser general public license",
    "REDISTRIBUTION and use in source and binary forms, with or without any modification are permitted; redistribution and use in binary forms with or without modification are permitted",
    "under the mit license under the mit license under the MIT LICENSE", "\u212aNOWN under the \u0130 mit license", "licensed under the gnu general public general public license version 3 version 2",
]


def test_places_against_brute_force(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(CASES)]
    got = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in L.scan(spark, make_docs(rows)).collect())
    assert got == sorted((str(d), *brute(t)) for d, t, _, _ in rows)
    assert L.scan(spark, make_docs([])).count() == 0


def test_voting_adds_labels_over_gaps(spark, make_docs):
    got = {r["doc_id"]: r for r in L.scan(spark, make_docs([(i, t, "en", "a") for i, t in enumerate(CASES)])).collect()}
    assert got[0]["labels"] == "mit" and got[2]["labels"] == "apache-2" and got[1]["labels"] == "cc-by-nc"
    assert got[4]["labels"] == "gpl-3" and got[4]["score"] == 1.0
    assert "gpl-3" in got[5]["labels"] and got[5]["score"] < 1.0 and got[5]["base_labels"] == ""
    assert got[8]["labels"] == "mit" and got[6]["labels"] == "" and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[10]["labels"] == "" and got[10]["score"] < 0.6  # each 3-gram stands, but two words later than the one before
    assert got[11]["labels"] == "gpl-2,lgpl" and got[13]["n_base"] == 3


def test_whole_table(spark, sf):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in L.scan(spark, documents(spark, sf)).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in documents(spark, sf).collect()}


def test_random_notices_against_brute_force(spark, make_docs):
    random.seed(11)
    words = sorted({w for _, t in L.BASE + L.NOTICES for w in t.split()})
    rows = []
    for d in range(120):
        w = []
        for _ in range(random.randint(0, 5)):
            w += [x for x in random.choice(L.BASE + L.NOTICES)[1].split() for x in random.choice([[x]] * 9 + [[], [x, random.choice(words)]])]
            w += random.choices(words, k=random.randint(0, 3))
        rows.append((d, random.choice([" ", ", "]).join(w), "en", "a"))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in L.scan(spark, make_docs(rows)).collect()}
    assert got == {d: brute(t) for d, t, *_ in rows}
