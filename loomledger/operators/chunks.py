"""Sync in chunks, for many logs at once: what a loop over chunks comes to, from running counts.

A push sends chunks of `size` pending events in seq order and stops behind the first chunk that is not wholly
acknowledged. So all that decides is the first event without an acknowledgement: the cursor stops before it, and its
chunk is the last that is sent. A delta run asks for chunks of wanted ids, of which those that the peer does not deliver
are asked for again in every later chunk; once they fill one, or nothing else is left, the run has idled and ends. So
what decides is the place where the ids held back come to `size`.

Both leave a state (what is acknowledged, wanted and dead) that is committed as one generation, so that a run that is
killed resumes from the last whole one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.operators.neighbours import running
from loomledger.sources.committed import create_if_absent, make_folder, newest
from loomledger.sources.scratch import written

PUSH_CHUNK, DELTA_CHUNK = 10, 50


def pushed(events: DataFrame, acks: DataFrame, cursors: DataFrame, unfit: DataFrame, log: str = "device_id", size: int = PUSH_CHUNK) -> DataFrame:
    """Pending events (seq beyond their log's cursor) with chunk, sent, server_time and outcome:

    acked; dead (acknowledged, but it does not fit the read-model: evidence is kept and the cursor goes on); held (sent, not
    within the leading run of acknowledged ones) or unsent. acks: (id, server_time). cursors: (log, since). unfit: (id).
    """
    since = cursors.select(F.col(log).alias("_log"), "since")
    rows = events.join(since, F.col(log) == F.col("_log"), "left").filter(F.col("seq") > F.coalesce("since", F.lit(0))).drop("_log", "since")
    rows = rows.drop("server_time").join(acks.groupBy("id").agg(F.min("server_time").alias("server_time"), F.lit(True).alias("_ok")), "id", "left")
    rows = rows.join(unfit.select("id").distinct().withColumn("_unfit", F.lit(True)), "id", "left")
    rows = running(rows, log, "seq", place=F.lit(1), missing=F.col("_ok").isNull().cast("int"))
    chunk = F.floor((F.col("place") - 1) / size)
    stops = rows.filter("missing = 1 and _ok is null").groupBy(log).agg(F.min(chunk).alias("_last")).withColumnRenamed(log, "_log")
    rows = rows.withColumn("chunk", chunk).join(stops, F.col(log) == F.col("_log"), "left")
    sent = F.coalesce(F.col("chunk") <= F.col("_last"), F.lit(True))
    run = F.col("missing") == 0
    outcome = F.when(~sent, "unsent").when(~run, "held").when(F.col("_unfit"), "dead").otherwise("acked")
    rows = rows.withColumns({"sent": sent, "outcome": outcome, "server_time": F.when(sent, F.col("server_time"))})
    return rows.drop("place", "missing", "_ok", "_unfit", "_log", "_last")


def push_summary(outcomes: DataFrame, cursors: DataFrame, log: str = "device_id") -> DataFrame:
    """Per log: events pushed, acked, dead, and `since`, the new cursor."""
    done = outcomes.groupBy(log).agg(
        F.count_if("sent").alias("pushed"), F.count_if(F.col("outcome") == "acked").alias("acked"), F.count_if(F.col("outcome") == "dead").alias("dead"),
        F.max(F.when(F.col("outcome").isin("acked", "dead"), F.col("seq"))).alias("_to"),
    )
    old = cursors.select(F.col(log).alias("_log"), F.col("since").alias("_since"))
    rows = done.join(old, F.col(log) == F.col("_log"), "full")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(F.coalesce(log, "_log").alias(log), zero("pushed"), zero("acked"), zero("dead"), F.coalesce("_to", "_since", F.lit(0)).alias("since"))


def delta(want: DataFrame, served: DataFrame, log: str = "device_id", size: int = DELTA_CHUNK) -> DataFrame:
    """Wanted ids (log, place, id) with what one run makes of each:

    applied; duplicate (wanted again, and stored by then); poison (delivered, but unfit: never asked for again); hold (not
    delivered, or not stored); left (the run had idled before it). served: (log, id, poison_reason, stored: false if storing fails).
    """
    got = served.groupBy(F.col(log).alias("_log"), F.col("id").alias("_id")).agg(F.max(F.col("poison_reason").isNotNull()).alias("_bad"), F.min(F.coalesce("stored", F.lit(True))).alias("_kept"))
    rows = want.join(got, (F.col(log) == F.col("_log")) & (F.col("id") == F.col("_id")), "left")
    word = F.when(F.col("_bad").isNull(), "hold").when(F.col("_bad"), "poison").when(~F.col("_kept"), "hold").otherwise("applied")
    rows = rows.withColumn("outcome", word).drop("_log", "_id", "_bad", "_kept")
    first = rows.groupBy(log, "id").agg(F.min("place").alias("_first")).select(F.col(log).alias("_log"), F.col("id").alias("_id"), "_first")
    rows = rows.join(first, (F.col(log) == F.col("_log")) & (F.col("id") == F.col("_id")))
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "applied") & (F.col("place") > F.col("_first")), "duplicate").otherwise(F.col("outcome"))).drop("_log", "_id", "_first")
    rows = running(rows, log, "place", held=(F.col("outcome") == "hold").cast("int"))
    before = F.col("held") - (F.col("outcome") == "hold").cast("int")
    return rows.withColumn("outcome", F.when(before >= size, "left").otherwise(F.col("outcome"))).drop("held")


def delta_summary(outcomes: DataFrame, log: str = "device_id") -> DataFrame:
    """Per log: wanted, applied, poisoned (ids), and done: nothing is wanted any more."""
    count = lambda *words: F.count_if(F.col("outcome").isin(*words))
    return outcomes.groupBy(log).agg(F.count("*").alias("wanted"), count("applied").alias("applied"), F.count_distinct(F.when(F.col("outcome") == "poison", F.col("id"))).alias("poisoned"), (count("hold", "left") == 0).alias("done"))


def remainder(outcomes: DataFrame, log: str = "device_id") -> DataFrame:
    """(log, place, id): what the next run wants first, numbered anew: ids held back before those that were left."""
    rows = outcomes.filter(F.col("outcome").isin("hold", "left"))
    rows = rows.withColumn("_order", F.when(F.col("outcome") == "left", 1 << 61).otherwise(0) + F.col("place"))
    return running(rows, log, "_order", rank=F.lit(1)).select(log, F.col("rank").alias("place"), "id")


def stored(relay: DataFrame, outcomes: DataFrame, lost: DataFrame) -> DataFrame:
    """The relay (its columns, and pos: order of arrival) with what a push has brought: all that was sent and not lost, also behind the first gap, each id once."""
    arrived = outcomes.filter("sent").join(lost.select("id"), "id", "left_anti").join(relay.select("id"), "id", "left_anti")
    top = relay.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_top"))
    placed = running(arrived.withColumn("_all", F.lit(0)), "_all", "seq", pos=F.lit(1)).crossJoin(F.broadcast(top))  # one row
    return relay.unionByName(placed.withColumn("pos", F.col("pos") + F.col("_top")).select(*relay.columns))


class State:
    """Tables of one sync, committed together: generation n is whole or not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def generation(self) -> int:
        return newest(self.spark, f"{self.path}/generations")

    def read(self, name: str, schema: str) -> DataFrame:
        n = self.generation()
        if not n:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.json(f"{self.path}/generations/{n:012d}.json").first()["folder"]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{held}/{name}")

    def write(self, tables: dict[str, DataFrame], after: int) -> bool:
        """Commit tables as the generation behind `after`; False if another run has been there first."""
        folder = f"tables-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        make_folder(self.spark, f"{self.path}/generations")
        return create_if_absent(self.spark, f"{self.path}/generations/{after + 1:012d}.json", json.dumps({"folder": folder}))


def delta_round(state: State, manifest: DataFrame, local: DataFrame, served: DataFrame, log: str = "device_id", size: int = DELTA_CHUNK) -> tuple[DataFrame, DataFrame]:
    """One resumable delta run per log: (outcomes, summary). manifest: (log, place, id). local: (log, id) that is stored or logged here.

    Ids of earlier runs that are still wanted come first; dead ids are not asked for. What is left over and dead is committed.
    """
    key = [log, "id"]
    generation = state.generation()
    dead = state.read("dead", f"{log} string, id string")
    old = state.read("want", f"{log} string, place long, id string").join(local.select(*key), key, "left_anti").join(dead, key, "left_anti")
    fresh = manifest.filter("id is not null and id <> ''").select(log, "place", "id").join(local.select(*key), key, "left_anti").join(dead, key, "left_anti")
    rest = fresh.join(old.select(*key), key, "left_anti")
    want = written(old.select(log, "place", "id").unionByName(rest.select(log, (F.col("place") + (1 << 41)).alias("place"), "id")), "want")
    outcomes = written(delta(want, served, log, size), "outcomes")
    summary = delta_summary(outcomes, log)
    gone = outcomes.filter("outcome = 'poison'").select(*key).distinct()
    if not state.write({"want": remainder(outcomes, log), "dead": dead.unionByName(gone)}, generation):
        raise RuntimeError("another run has committed this generation")
    return outcomes, summary

