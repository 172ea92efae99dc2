"""Resumable loads: new files are picked up once; the stream's checkpoint and the tables' commit log say what is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill import reach_workers
from oathmill.plans.commits import Change, Log, Snapshot
from oathmill.sources.files import MANIFEST


def land(spark: SparkSession, folder: str, schema: str, done: str, apply: Callable[[DataFrame, int], None], form: str = "json") -> None:
    """Hand the files that are new since the last call to ``apply`` (a batch and its number), then stop."""
    query = spark.readStream.schema(schema).format(form).load(folder).writeStream.foreachBatch(apply).option("checkpointLocation", done).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(old: DataFrame, batch: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last row of each key, by ``seq``; of an old and a new row that are equal in it, the new one."""
    both = old.select("*", F.lit(0).alias("batch_")).unionByName(batch.select(*old.columns, F.lit(1).alias("batch_")))
    rest = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*seq, "batch_")).alias("r")).select(*key, "r.*").select(*old.columns)


def merged(log: Log, table: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch into a table of the log exactly once. The commit that holds a batch's rows
    also marks its number for this stream (known by the id in its checkpoint), so a replayed batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        stream = f"{table}:{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"

        def change(at: Snapshot) -> Change:
            if at.marks.get(stream, -1) >= number:
                return None
            return {table: merge(log.read(table, schema, at), batch)}, {stream: number}

        log.update(change)

    return apply


def land_upsert(spark: SparkSession, folder: str, schema: str, log: Log, table: str, key: list[str], seq: list[str], done: str, form: str = "json", files: int = 1000) -> None:
    """Land the new files of a folder in a table of the log, one row per key, ``files`` at a time, then stop."""
    lines = spark.readStream.schema(schema).format(form).option("maxFilesPerTrigger", files).load(folder)
    apply = merged(log, table, schema, lambda old, batch: newest(old, batch, key, seq))
    lines.writeStream.foreachBatch(apply).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()


STATE = f"{MANIFEST}, file string, start long, nth long"
_LINE = "value string, file string, start long, nth long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        nth = pa.array(range(done, done + batch.num_rows), pa.int64())
        done += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, nth], [*batch.schema.names, "nth"])


def placed(lines: DataFrame) -> DataFrame:
    """Lines (value, file, start: where the part of a file that a task reads begins) with their number ``nth`` in the task, which reads a
    part's lines in order: (file, start, nth) is the order of all. Spark's own row numbers are not for streams."""
    return lines.select("value", "file", "start").mapInArrow(_counted, _LINE)


def last_lines(lines: DataFrame) -> DataFrame:
    """Per address its last line, files in order of their names: keyed state if ``lines`` (value, file, start, nth) is a stream."""
    rows = lines.select(F.from_json("value", MANIFEST).alias("r"), "file", "start", "nth").where("coalesce(r.profile_url, '') <> ''")
    last = rows.groupBy(F.col("r.profile_url").alias("u")).agg(F.max_by(F.struct("r", "file", "start", "nth"), F.struct("file", "start", "nth")).alias("m"))
    return last.select("m.r.*", "m.file", "m.start", "m.nth")


def follow_manifest(spark: SparkSession, folder: str, log: Log, table: str, done: str, files: int = 1000) -> None:
    """Keep a table of each address's last manifest line, over files that come in any order. Each batch updates the stream's state store
    by address; what changed is merged into the table. Large files are read in parts; no file need fit in memory."""
    reach_workers(spark)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    apply = merged(log, table, STATE, lambda old, batch: newest(old, batch, ["profile_url"], ["file", "start", "nth"]))
    last_lines(placed(lines)).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()
