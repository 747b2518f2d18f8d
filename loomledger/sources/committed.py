"""Logs that are written and read back: appends become visible by one conditional create each.

A folder holds many logs (one a device, say). An append writes, in this order: the lines under
`data/commit=<c>/log=<l>/`, one file a log; what each file holds and the ids in it under `segments/` and `ids/`; and
last a small file `commits/<n>.json`, created only if it does not exist. Readers join on the commits, so that what a
writer left that was killed before the last step is never seen, and of two writers one wins and the other chains its
events anew to the new tips. A batch name makes a commit repeatable: a batch that is committed changes nothing when it
comes again, as `foreachBatch` asks for. The file system must create files atomically, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomledger.functions.canonical import quoted
from loomledger.operators.chain import chained
from loomledger.schema import EVENT
from loomledger.sources import log as logs

TRIES = 8
_COMMIT = "n long, batch string, commit string"
_SEGMENT = "log string, lines long, last_seq long, tip string, commit string"


class Conflict(Exception):
    """Other writers have won each time."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if another has done so. Its content is written before it has its name."""
    fs, where = _fs(spark, path)
    draft = where.getParent().suffix(f"/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename only looks first whether the name is taken; a link fails if it is
            os.link(draft.toUri().getPath(), where.toUri().getPath())
            return True
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, where, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # refuses to replace
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(draft, False)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.mkdirs(where)


def newest(spark: SparkSession, path: str) -> int:
    """The greatest number of the files `<n>.json` in a folder; 0 if there are none."""
    fs, where = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(n, batch, commit) of every commit."""
    fs, where = _fs(spark, f"{path}/commits")
    if not fs.exists(where):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).option("pathGlobFilter", "*.json").json(f"{path}/commits")


def _committed(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    """A table's rows of commits, with their numbers."""
    fs, where = _fs(spark, f"{path}/{what}")
    rows = spark.read.schema(schema).parquet(f"{path}/{what}") if fs.exists(where) else spark.createDataFrame([], schema)
    return rows.join(F.broadcast(commits(spark, path).select("n", "commit")), "commit")  # a row of three short fields an append


def tips(spark: SparkSession, path: str) -> DataFrame:
    """(log, max_seq, last_hash): where each log goes on."""
    last = _committed(spark, path, "segments", _SEGMENT).groupBy("log").agg(F.max_by(F.struct("last_seq", "tip"), "n").alias("t"))
    return last.select("log", F.col("t.last_seq").alias("max_seq"), F.col("t.tip").alias("last_hash"))


def line(log: str) -> Column:
    """An event as one line: fields that are null are left out, the payload is an object as it was given."""
    text = {k: quoted(F.col(k)) for k in ("id", "type", "actor", "device_id", "prev_hash", "hash", "origin_device", "signature")}
    number = {k: F.col(k).cast("string") for k in ("seq", "ts_device", "origin_seq", "server_time")}
    other = {"payload": F.regexp_replace(F.coalesce("payload", F.lit("{}")), r"[\r\n]", " "), "countersignatures": F.to_json("countersignatures")}
    order = [f.split()[0] for f in EVENT.split(", ") if " " in f and not f.startswith("signatureHex")]
    parts = [F.when(F.col(k).isNotNull() | F.lit(k == "payload"), F.concat(F.lit(f'"{k}":'), (text | number | other)[k])) for k in order]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _filled(events: DataFrame) -> DataFrame:
    """Events with every column of the schema."""
    kinds = {f.split()[0]: f.split()[1] for f in EVENT.split(", ")}
    return events.withColumns({c: F.lit(None).cast(kind if "<" not in kind else "array<struct<deviceId:string,signatureHex:string>>") for c, kind in kinds.items() if c not in events.columns})


def refused(events: DataFrame, log: str, known: DataFrame) -> DataFrame:
    """(reason, id): why a batch may not be appended. known: (log, id) that are there."""
    # fixed values: what a refusal is called
    shape = (
        F.when(F.col(log).isNull(), "log.append: an event names no log")
        .when(F.col("type").isNull() | (F.col("type") == ""), "log.append: type must be a non-empty string")
        .when(F.col("payload").isNotNull() & F.try_parse_json("payload").isNull(), "log.append: payload is no JSON")
    )
    wrong = events.select(shape.alias("reason"), "id").filter("reason is not null")
    again = events.groupBy(log, "id").agg(F.count("*").alias("n")).filter("n > 1")
    there = known.join(events.select(F.col(log).alias("log"), "id").distinct(), ["log", "id"], "left_semi")
    twice = again.select("id").unionByName(there.select("id")).filter("id is not null")
    return wrong.unionByName(twice.select(F.concat(F.lit("log.append: duplicate id "), "id").alias("reason"), "id"))


def append(events: DataFrame, path: str, log: str = "device_id", batch: str | None = None) -> int:
    """Chain events to the tips of their logs, in seq order within each, and commit them; the number of the commit.

    Events need id, seq (their order), type, device_id, ts_device and payload. An event without an id gets one. Refused as a
    whole, with nothing written: an empty type, a payload that is no JSON, an id that its log has or that stands twice.
    """
    spark = events.sparkSession
    for _ in range(TRIES):
        done = commits(spark, path)
        if batch is not None and (old := done.filter(F.col("batch") == batch).agg(F.min("n")).first()[0]) is not None:
            return old
        head = done.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        new = _filled(events)
        why = refused(new, log, _committed(spark, path, "ids", "log string, id string, commit string")).agg(F.min("reason")).first()[0]
        if why:
            raise ValueError(why)
        commit = uuid.uuid4().hex
        new = new.withColumn("id", F.coalesce("id", F.uuid()))
        rows = chained(new, log, tips(spark, path))
        rows.select(line(log).alias("value"), F.col(log).cast("string").alias("log")).write.partitionBy("log").text(f"{path}/data/commit={commit}")
        written = spark.read.schema("value string, log string").text(f"{path}/data/commit={commit}")
        own = written.select("log", F.from_json("value", "id string, seq long, hash string").alias("e")).select("log", "e.*")
        segments = own.groupBy("log").agg(F.count("*").alias("lines"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("tip"))
        segments.write.parquet(f"{path}/segments/commit={commit}")
        own.select("log", "id").write.parquet(f"{path}/ids/commit={commit}")
        make_folder(spark, f"{path}/commits")
        if create_if_absent(spark, f"{path}/commits/{head + 1:012d}.json", json.dumps({"n": head + 1, "batch": batch, "commit": commit})):
            return head + 1
        for what in ("data", "segments", "ids"):
            fs, where = _fs(spark, f"{path}/{what}/commit={commit}")
            fs.delete(where, True)
    raise Conflict(f"{TRIES} commits of other writers came first")


def scanned(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    """log.scanned over what is committed: each log's segments, one after the other, as one log."""
    segments = _committed(spark, path, "segments", _SEGMENT)
    ahead = F.coalesce(F.sum("lines").over(Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = segments.select("log", "commit", ahead.alias("behind"))
    raw = spark.read.schema("value string, commit string, log string").text(f"{path}/data")
    return logs.judged(logs.placed(raw.selectExpr("log", "commit", *logs.WHERE, "value AS raw"), segments), word)


def removed_leftovers(spark: SparkSession, path: str) -> int:
    """Delete what writers left that never committed; to be run while none writes. The number of commits removed."""
    known = {r["commit"] for r in commits(spark, path).select("commit").collect()}
    gone = set()
    for what in ("data", "segments", "ids"):
        fs, where = _fs(spark, f"{path}/{what}")
        for s in fs.listStatus(where) if fs.exists(where) else []:
            name = s.getPath().getName().removeprefix("commit=")
            if name not in known:
                gone.add(name)
                fs.delete(s.getPath(), True)
    return len(gone)
