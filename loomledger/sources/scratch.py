"""Tables written once in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Only a local session without one, as in tests, gets a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledger"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a stored Parquet table: it survives lost executors, and filters and pruning reach it. It goes when the application ends, or with its run()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    _made.folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


class _Made(threading.local):
    """The tables that each thread has made."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread makes inside go at its end, so what they serve must be written or collected by then."""
    begun = len(_made.folders)
    try:
        yield
    finally:
        for path in _made.folders[begun:]:
            fs, where = _hadoop(spark, path)
            fs.delete(where, True)
        del _made.folders[begun:]
