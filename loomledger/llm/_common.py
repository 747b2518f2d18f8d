"""Helpers shared by the training-data operators: scratch tables and word rules."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two word rules and the ASCII letters they lower-case.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch. The JVM holds a batch twice beside its heap, and Python once more, for every task.
BATCH_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. Only a local session without one gets a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomledger"


class _Made(threading.local):
    """Folders of scratch tables in the order they were made, for each thread its own: runs in other threads are not touched."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def noted(spark: SparkSession, folder: str) -> str:
    """A folder that goes with this run's scratch tables, and at the latest when the application ends."""
    _made.folders.append(folder)
    fs, path = _hadoop(spark, folder)
    fs.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that later steps don't recompute it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    noted(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many scratch tables this thread has made, as a mark for drop_made."""
    return len(_made.folders)


def drop_made(spark: SparkSession, since: int, but_last: bool = False) -> None:
    """Delete this thread's scratch tables since a mark (but for the last one), once all that reads them is itself written."""
    end = len(_made.folders) - but_last
    for folder in _made.folders[since:end]:
        fs, path = _hadoop(spark, folder)
        fs.delete(path, True)
    del _made.folders[since:end]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A run: its scratch tables go at its end, so what it returns must be written or collected inside."""
    begun = made()
    try:
        yield
    finally:
        drop_made(spark, begun)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, what an action sends to Python at once ends at BATCH_BYTES or after one row, not at a number of rows alone; a bound that the session has set stays."""
    if spark.conf.get(_BATCH_BYTES, None):
        yield
        return
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts that are all ASCII take the fast built-in; others keep their accents' case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def alnum_words(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_CLASS), "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4: rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def id_text(column: str) -> Column:
    """An id as pandas gets it: as a text, since pandas makes doubles of whole numbers where one is null."""
    return F.col(column).cast("long").cast("string").alias(column)


def ids(texts) -> pd.api.extensions.ExtensionArray:
    """Whole numbers of what id_text() sent."""
    return pd.array([None if t is None else int(t) for t in texts], "Int64")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
