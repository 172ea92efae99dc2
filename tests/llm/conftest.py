from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, th long, spans string, size int, fp string, row int, bucket int, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(d, t, la, s, None if t is None else len(t), 1, 1, "x", 1, "x", 1, 1, "x") for d, t, la, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    passage = " ".join(f"p{i}" for i in range(60))
    return [
        (1, "Alpha beta gamma. " * 30, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \n\t ", "de", "b"), (5, "ﬁne été 漢字 \U0001F600 *** \n x\n x\n", "fr", "b"),
        (6, passage, "en", "a"), (7, passage + " tail of its own here", "en", "c"), (7, passage + " tail of its own here", "en", "c"), (8, "word " * 40_000, "en", "c"), (9, "y" * 30_000, None, "c"), (None, passage, "en", "a"), (10, "one two", "en", None),
    ]
