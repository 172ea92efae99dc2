"""The corpus operators as pipeline stages: documents in, documents out.

Verdicts are for rows, not for doc_ids: a row is known by its doc_id, which may be
null or repeat, and a hash of all its columns. Only rows equal in every column
share a verdict, or their number of copies in the mix. Each stage reads the columns
of documents alone: extra ones, whatever their names, are left out, and an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, near_copies, quality_rules, sentencepiece_codec, substring_dedup
from .shared import repeated

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: What a row is joined by: a null-safe doc_id and ``row``, the hash of its columns.
KEY = ("nameless", "id", "row")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"nameless": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})


def _rows(docs: DataFrame) -> DataFrame:
    """COLUMNS and KEY. A hash passes over nulls, so it takes in which columns are null."""
    rest = [x for c in COLUMNS[1:] for x in (F.col(c), F.col(c).isNull())]
    return _named(docs.select(*COLUMNS).withColumn("row", F.xxhash64(*rest)))


def _once(rows: DataFrame) -> DataFrame:
    """KEY and the row as ``r``, one of rows that are equal."""
    return rows.groupBy(*KEY).agg(F.first(F.struct(*COLUMNS)).alias("r"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, each judged by itself."""
    return quality_rules.judge(spark, docs.select(*COLUMNS), carry=("text", "n_chars")).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (op7's links and those of similarity 0.8): that of the smallest doc_id (a null one last), then of the smallest hash."""
    rows = _rows(docs)
    kept = _named(near_copies.representatives(spark, rows)).select(*KEY)
    return _once(rows).join(kept, [*KEY], "left_semi").select("r.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that a smaller doc_id has; a document with no word left goes."""
    return substring_dedup.remove_repeats(spark, docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it (0 to 3); copies keep their doc_id."""
    rows = _rows(docs)
    groups = mixing.mixed_groups(spark, rows, "row").withColumn("copies", F.col("twins") * F.col("copies") + F.col("more")).where("copies > 0")
    taken = _named(groups).groupBy(*KEY).agg(F.sum("copies").alias("copies"))
    return repeated(_once(rows).join(taken, [*KEY]), F.col("copies"), "copy").select("r.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, one row per row of the mix."""
    return sentencepiece_codec.encode(spark, docs.select(*COLUMNS)).withColumn("n_tokens", F.size("ids").cast("long"))
