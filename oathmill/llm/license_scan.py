"""License scans by diagonal voting, in Spark expressions and joins only.

Texts are lower-cased in A-Z; words are runs of digits, letters and anything
beyond ASCII. Every word 3-gram's hash is joined to the positions of the fixed
phrases and notices below (a table of constant size, so it is broadcast), and a hash
hit is checked against the words themselves. A hit votes for the diagonal (word
position - template position). Base phrases stand where all their 3-grams vote for
one diagonal.

Each diagonal with votes opens a span of itself and its neighbours up to DRIFT words
further on, as after added or lost words; the drift of a whole span is bounded. A span
is verified against its template in order: for one template position after the other,
the first hit behind the last one taken counts. The share of the template's 3-grams
that count so is the span's score; it begins at its first word taken and ends after
its last. A notice's span of SPAN_SHARE or more earns the label unless one that overlaps
it (or a chain of overlapping ones) scores higher; of equal ones all labels stay. A
document's score is its best span's.

Null and empty texts have no words, labels or places, and score 0. A null doc_id is kept.
Repeated rows are scanned one by one. A long text is scanned whole; its words are one
array. Extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, DRIFT, SPAN_SHARE = 3, 4, 0.6
#: Base phrases with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices that the voting adds, with their labels.
NOTICES = (
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters beyond ASCII whose lower case has an ASCII letter, each with one that has not.
FOREIGN = (("\u212a", "\u0138"), ("\u0130", "\u0131"))


def template_grams(spark: SparkSession) -> DataFrame:
    """template, label, base, length (words), tpos, t0, t1, t2, h: a row per 3-gram of a template."""
    rows = []
    for number, (base, (label, text)) in enumerate([(True, t) for t in BASE] + [(False, t) for t in NOTICES]):
        words = text.split()
        rows += [(number, label, base, len(words), i, *words[i : i + K]) for i in range(len(words) - K + 1)]
    grams = ", ".join(f"t{i} string" for i in range(K))
    return spark.createDataFrame(rows, f"template int, label string, base boolean, length int, tpos int, {grams}").withColumn("h", F.xxhash64(*[f"t{i}" for i in range(K)]))


def lowered(text: Column) -> Column:
    """A-Z in lower case. Letters beyond ASCII may change too, but never into or out of a template's words."""
    for there, instead in FOREIGN:
        text = F.replace(text, F.lit(there), F.lit(instead))
    return F.lower(text)


def in_order(near: Column, grams: Column) -> Column:
    """struct<last, first, n> of the hits that follow the template; ``near``: array<struct<diagonal, hits>> of a span."""

    def step(a: Column, t: Column) -> Column:
        there = F.array_min(F.transform(near, lambda d: F.when(F.array_contains(d["hits"], t) & (d["diagonal"] + t > a["last"]), d["diagonal"] + t)))
        return F.struct(F.coalesce(there, a["last"]).alias("last"), F.coalesce(a["first"], there).alias("first"), (a["n"] + there.isNotNull().cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(0), grams - 1), F.struct(F.lit(-1).alias("last"), F.lit(None).cast("int").alias("first"), F.lit(0).alias("n")), step)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    words = F.regexp_extract_all(lowered(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))
    n = F.size("words")
    # no lambda: zipped and exploded arrays stay in generated code
    grams = F.arrays_zip(F.col("words").alias("w0"), *[F.slice("words", i + 1, F.greatest(n, F.lit(1))).alias(f"w{i}") for i in range(1, K)])
    rows = rows.select("doc_id", "row", n.cast("long").alias("n_words"), F.posexplode_outer(grams).alias("pos", "g")).select("doc_id", "row", "n_words", "pos", *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(K)])
    meant = F.xxhash64(*[f"w{i}" for i in range(K)]) == F.col("h")
    for i in range(K):
        meant = meant & (F.col(f"w{i}") == F.col(f"t{i}"))
    hits = rows.join(F.broadcast(template_grams(spark)), meant, "left").where(F.col("template").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    key = ["doc_id", "row"]
    votes = hits.groupBy(*key, "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), (F.first("length") - K + 1).alias("grams"), F.collect_set("tpos").alias("hits"))
    # a diagonal holds at most a template's 3-grams, a span at most DRIFT + 1 diagonals
    onward = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(Window.currentRow, DRIFT)
    spans = votes.withColumn("near", F.collect_list(F.struct("diagonal", "hits")).over(onward))
    spans = spans.select(
        *key, "n_words", "label", F.coalesce("base", F.lit(False)).alias("base"), "grams",
        F.when(F.col("base") & (F.size("hits") == F.col("grams")), F.col("diagonal")).cast("long").alias("place"), in_order(F.col("near"), F.col("grams")).alias("chain"))
    share = F.when(F.col("grams").isNotNull(), F.col("chain.n") / F.col("grams")).otherwise(0.0)
    spans = spans.select(*key, "n_words", "label", "base", "place", share.alias("share"), F.col("chain.first").alias("begin"), (F.col("chain.last") + K).alias("end"))
    # of notices whose spans overlap, the best one is meant
    spans = spans.withColumn("fits", ~F.col("base") & (F.col("share") >= SPAN_SHARE))
    among = Window.partitionBy(*key, "fits").orderBy("begin", "end")
    fresh = F.coalesce(F.col("begin") >= F.max("end").over(among.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("part", F.sum(fresh.cast("int")).over(among))
    best = F.max("share").over(Window.partitionBy(*key, "fits", "part"))
    spans = spans.withColumn("fits", F.col("fits") & (F.col("share") == best))
    base_label = F.when(F.col("place").isNotNull(), F.col("label"))
    label = F.coalesce(base_label, F.when(F.col("fits"), F.col("label")))
    out = spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base_label)), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(label.isNotNull(), F.struct("begin", "end", "label", "share")))).alias("spans"))
    return out.drop("row")
