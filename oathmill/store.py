"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="affidavits-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and its class of paths."""
    cls = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), cls


def remove(spark: SparkSession, path: str) -> None:
    try:
        store, cls = filesystem(spark, path)
        store.delete(cls(path), True)
    except Exception:  # the session has ended; its shared folder goes with it
        pass


class Scratch:
    """Tables between the steps of an iteration: rows are reread, so lineage does not grow and a lost executor costs one step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")
