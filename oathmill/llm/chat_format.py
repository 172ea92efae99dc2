"""Chat formatting with Spark expressions only.

One row per conversation. Turns are sorted by (turn, role, text), nulls first; a
null role or text counts as empty; repeated rows are turns of their own. Adjacent
turns of one role share a block:

    <s><|im_start|>role<|im_sep|>text<|turn|>text<|im_end|><|im_start|>...

Every marker starts with ``<`` or ``[`` and goes on with something other than a
backslash. In texts and roles each ``<``, ``[`` and backslash is followed by an
added backslash, so no text can hold a marker, and dropping those backslashes
from left to right gives the text back. The loss mask is a list of (start,
length) spans over the formatted text, counted in code points; markers are
outside it. Rows with a null conv_id form one conversation. An empty table gives
an empty table. Extra columns are left out.

One conversation is one row, in one task. Arrays that grow while they are folded, and
places counted from the beginning of a text, are kept to CHUNK items at a time, so the work
for n turns grows as n * (CHUNK + n / CHUNK): a square remains, but a CHUNK-th of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, START, SEP, TURN, END = "<s>", "<|im_start|>", "<|im_sep|>", "<|turn|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Items that are folded, or cut out of a text, at once.
CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[<\[\\]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _blocks(turns: Column) -> Column:
    """Runs of one role as struct<role, texts>."""
    last = F.size(turns) - 1
    begins = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(begins.alias("b"), ends.alias("e")),
        lambda r: F.struct(F.get(turns, r["b"])["role"].alias("role"), F.transform(F.sequence(r["b"], r["e"] - 1), lambda i: F.get(turns, i)["text"]).alias("texts")),
    )


def _chunks(items: str) -> Column:
    """The array in arrays of CHUNK (one empty array for none)."""
    last = F.call_function("div", F.greatest(F.size(items), F.lit(1)) - 1, F.lit(CHUNK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))


def _spans(pieces: Column) -> Column:
    """struct<length, spans>: the code points of all pieces, and where among them those of the loss are."""
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("length"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["length"] + F.char_length(p["s"])).alias("length"),
            F.when(p["loss"], F.array_append(acc["spans"], F.struct(acc["length"].alias("start"), F.char_length(p["s"]).cast("long").alias("length")))).otherwise(acc["spans"]).alias("spans"),
        ),
    )


def _begins(parts: Column) -> Column:
    """Where each part begins in the formatted text."""
    return F.aggregate(
        parts,
        F.struct(F.lit(len(BOS)).cast("long").alias("at"), F.array().cast("array<bigint>").alias("begins")),
        lambda acc, p: F.struct((acc["at"] + p["length"]).alias("at"), F.array_append(acc["begins"], acc["at"]).alias("begins")),
        lambda acc: acc["begins"],
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, length>>."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    # Each piece of output: its string, and whether the loss counts it.
    def pieces(block: Column) -> Column:
        trained = block["role"] == TRAINED_ROLE
        head = F.struct(F.concat(F.lit(START), escape(block["role"]), F.lit(SEP)).alias("s"), F.lit(False).alias("loss"))
        tail = F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))
        bodies = F.transform(block["texts"], lambda t, i: F.array(
            F.struct(F.when(i > 0, TURN).otherwise("").alias("s"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("s"), trained.alias("loss"))))
        return F.concat(F.array(head), F.flatten(bodies), F.array(tail))

    rows = rows.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    text = F.concat(F.lit(BOS), F.array_join(F.transform("pieces", lambda p: p["s"]), ""))
    rows = rows.select("conv_id", text.alias("formatted"), F.transform(_chunks("pieces"), _spans).alias("parts"))
    moved = F.zip_with("parts", _begins(F.col("parts")), lambda p, at: F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length"))))
    return rows.select("conv_id", "formatted", F.flatten(moved).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>> and loss_text, taken from the formatted text and its spans alone."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.greatest(F.char_length("formatted"), F.lit(1)))

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|im_sep\|>")
        body = F.replace(F.get(parts, F.lit(1)), F.lit(END), F.lit(""))
        return F.transform(F.split(body, r"<\|turn\|>"), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    def cut(text: Column, start: Column, length: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), length.cast("int"))

    def part(spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0)), F.get(spans, F.size(spans) - 1)
        return F.struct(spans.alias("spans"), first["start"].alias("at"), cut(F.col("formatted"), first["start"], last["start"] + last["length"] - first["start"]).alias("text"))

    parts = F.transform(_chunks("loss_spans"), part)
    loss = F.flatten(F.transform(parts, lambda p: F.transform(p["spans"], lambda s: unescape(cut(p["text"], s["start"] - p["at"], s["length"])))))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(loss, "")})
