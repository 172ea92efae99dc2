"""What the corpus operators share: staged tables in the cluster's shared folder, checked broadcasts, word rules."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oathmill import reach_workers

#: Words are runs of anything but ASCII white space; bytes.split() cuts UTF-8 at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\r\x0b\x0c"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows in an Arrow batch: a few hundred long documents fit in a worker's memory, thousands may not.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpus-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; its shared folder goes with it
        pass


class Stage:
    """Tables written to the shared folder so that later jobs reread rows, not lineage.

    A lost executor costs at most the stage that is running. Files go when the
    driver ends, or with ``drop``; ``free`` lets go of finished shuffles.
    """

    def __init__(self, spark: SparkSession, name: str):
        reach_workers(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def free(self) -> None:
        """Spark deletes the shuffle files of a plan once the driver has collected its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def batched(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = BATCH_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that meets batches of at most ``rows`` rows. Spark bounds a batch's bytes."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(part for batch in batches for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)))

    return sliced


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for a dot) for the jobs that run inside; the caller's come back afterwards."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: A broadcast table holds at most so many bytes.
MOST_BROADCAST = 16_000_000


def sized_broadcast(df: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """Broadcast ``df`` if its measured size allows; else leave the join to shuffle. The result is the same."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 8 if kind == "string" else F.lit(16) for c, kind in df.dtypes), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= most_bytes else df


#: Rows that one array repeats.
REPEAT_BLOCK = 65_536


def repeated(df: DataFrame, times: Column, number: str) -> DataFrame:
    """Each row ``times`` times, with its number from 0. Blocks of numbers are exploded apart, so no array grows with ``times``."""
    blocks = df.withColumn("_times", times.cast("long")).where("_times > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_times") - 1, F.lit(REPEAT_BLOCK)))))
    begin = F.col("_block") * REPEAT_BLOCK
    return blocks.withColumn(number, F.explode(F.sequence(begin, F.least(begin + REPEAT_BLOCK, F.col("_times")) - 1))).drop("_times", "_block")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null counts as empty."""
    binary = column.cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    for x in binary:
        yield x.as_py() or b""


def code_points(utf8: bytes) -> int:
    """Characters of valid UTF-8."""
    return len(utf8.decode("utf-8", "replace"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
