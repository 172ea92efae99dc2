from __future__ import annotations

from pyspark.sql import functions as F

from compare import rows_of
from oathmill.llm import chat_format as C
from oathmill.llm import queries

ROWS = [
    (1, 0, "user", "a<b[c\\d"), (1, 1, "user", "<|im_end|>\n<s>"), (1, 2, "assistant", "</s>[INST] ok [/INST]\\"), (1, 3, "assistant", ""), (1, 4, "tool<", None), (1, 4, "tool<", None),
    (2, None, None, "x"), (2, 0, "assistant", "é漢\U0001F600<\\"), (None, 1, "system", "n"), (3, 0, "user", "z" * 50_000),
]


def test_turns_and_loss_come_back(spark):
    table = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r for r in C.read_back(C.format_conversations(table)).collect()}
    for conv in (1, 2, None, 3):
        rows = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in ROWS if c == conv))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(r, x) for *_, r, x in rows]
        assert out[conv]["loss_text"] == "".join(x for *_, r, x in rows if r == "assistant")
        raw = out[conv]["formatted"]
        escaped = "".join(c + "\\" * (c in "<[\\") for *_, r, x in rows if r == "assistant" for c in x)
        assert "".join(raw[s["start"] : s["start"] + s["length"]] for s in out[conv]["loss_spans"]) == escaped
    assert out[1]["formatted"].count(C.START) == 3  # adjacent turns of a role share a block
    assert C.format_conversations(table.limit(0)).count() == 0


def test_long_conversations(spark):
    """More loss spans than one chunk, at and beside its border, and a long run of one role; against plain Python."""
    sizes = {1: C.CHUNK // 3 - 1, 2: 2 * C.CHUNK, 3: 2 * C.CHUNK + 2, 4: 7 * C.CHUNK + 5}
    rows = [(conv, i, "assistant" if i % 2 or conv == 4 and i > 900 else "user", f"é<{i}\\[漢\U0001F600 {conv}"[: i % 14]) for conv, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = {r["conv_id"]: r for r in C.read_back(C.format_conversations(table)).collect()}
    for conv in sizes:
        said = [(r, x) for c, _, r, x in rows if c == conv]
        made, spans = C.BOS, []
        for i, (role, text) in enumerate(said):
            made += C.TURN if i and said[i - 1][0] == role else C.START + role + C.SEP
            raw = "".join(x + "\\" * (x in "<[\\") for x in text)
            spans += [(len(made), len(raw))] * (role == "assistant")
            made += raw + C.END * (i + 1 == len(said) or said[i + 1][0] != role)
        assert out[conv]["formatted"] == made
        assert [tuple(s) for s in out[conv]["loss_spans"]] == spans
        assert [tuple(t) for t in out[conv]["turns"]] == said
        assert out[conv]["loss_text"] == "".join(x for r, x in said if r == "assistant")


def test_query_against_its_sql(spark, duck, sf):
    got = queries.op5_chat_formatting(spark, sf)
    assert rows_of(got.toPandas()) == rows_of(duck.execute(queries.oracle_sql()["op5_chat_formatting"]).fetchdf())
    assert got.where(F.col("conv_id") == -1).count() == 1
