"""Sweeping a sealed prefix, snapshots and excision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.operators.fold import rebuilt_tally
from loomledger.operators.tombstone import guard
from loomledger.schema import GENESIS


def swept(log: DataFrame, sealed: int) -> tuple[DataFrame, dict | None]:
    """The log after the seal, and its marker (null if nothing was removed): where the chain goes on and from which hash."""
    gone = log.filter(F.col("seq") <= sealed).agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("tip")).first()
    if not gone["n"]:
        return log, None
    marker = {"v": 1, "truncated_before": sealed + 1, "tip": gone["tip"] or GENESIS, "next_seq": sealed + 1}
    return log.filter(F.col("seq") > sealed), marker


def swept_logs(events: DataFrame, seals: DataFrame, log: str) -> tuple[DataFrame, DataFrame]:
    """Many logs at once, each to its seal (log, sealed): the events left, and (log, truncated_before, tip, next_seq, removed) of logs that lost any."""
    rows = events.join(seals.select(log, "sealed"), log, "left")
    gone = F.coalesce(F.col("seq") <= F.col("sealed"), F.lit(False))
    marks = rows.filter(gone).groupBy(log).agg((F.max("sealed") + 1).alias("truncated_before"), F.max_by("hash", "seq").alias("tip"), F.count("*").alias("removed"))
    return rows.filter(~gone).drop("sealed"), marks.withColumn("next_seq", F.col("truncated_before"))


def truncated(log: DataFrame, events: DataFrame, held: DataFrame, sealed: int, ack: int) -> tuple[DataFrame, dict]:
    """The log swept to a guarded seal, and the report: removed, kept, sealed, marker, held, pairs. events: the typed events of the read-model."""
    effective, holds, parted = guard(events, log, held, sealed, ack)
    rest, marker = swept(log, effective)
    total, kept = log.count(), rest.count()
    return rest, {"removed": total - kept, "kept": kept, "sealed": effective, "marker": marker, "held": holds, "pairs": parted}


def excised(views: dict[str, DataFrame], kept: DataFrame, forgive_below: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """Views without the events that the log no longer has, and the excised ids. What those did to others stays; the tally is summed anew."""
    gone = views["events"].filter(F.col("seq") >= forgive_below).join(kept.select("seq"), "seq", "left_anti").select("id", "seq")
    out = {name: df.join(gone.select("seq"), "seq", "left_anti") for name, df in views.items() if name != "tally"}
    return out | {"tally": rebuilt_tally(out["tally_moves"])}, gone.select("id")


def _holds_files(df: DataFrame, folder) -> bool:
    fs = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(folder) and len(fs.listStatus(folder)) > 0


def snapshot(views: dict[str, DataFrame], path: str, sealed: int) -> dict:
    """Write every view below a new folder; the manifest row is written last and makes the snapshot valid. A folder that another snapshot writes to or has written is refused."""
    folder = views["events"].sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if _holds_files(views["events"], folder):
        raise RuntimeError(f"ERR_SNAPSHOT_IN_FLIGHT: {path}")
    for name, df in views.items():
        df.write.parquet(f"{path}/{name}")
    top = views["events"].agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    spark = views["events"].sparkSession
    spark.createDataFrame([(path, sealed, top)], "path string, sealed_seq long, db_seq long").coalesce(1).write.parquet(f"{path}/_manifest")
    return {"snapshot": path, "sealed_seq": sealed, "db_seq": top}
