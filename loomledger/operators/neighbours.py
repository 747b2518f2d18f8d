"""The row before each row of an ordered log, without sending a whole log through one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.sources.scratch import written

#: Places of a log that one window sees.
ZONE = 1 << 20
#: Places of a log whose pointers one task follows.
POINTERS = 1 << 16


def before(rows: DataFrame, log: str, order: str, name: str, *columns: str) -> DataFrame:
    """rows plus `name`: the columns of the log's row before, null at its start. order: a log's places as whole numbers.

    Zones of a log are compared apart; a zone's first row takes the last row of the zone before, of which there is one each.
    """
    own = F.struct(*columns)
    rows = rows.withColumn("_zone", F.floor(F.col(order) / ZONE))
    edges = rows.groupBy(log, "_zone").agg(F.max_by(own, order).alias("_last"))
    edges = edges.select(F.col(log).alias("_log"), F.col("_zone").alias("_z"), F.lag("_last").over(Window.partitionBy(log).orderBy("_zone")).alias("_edge"))
    rows = rows.withColumn("_inside", F.lag(own).over(Window.partitionBy(log, "_zone").orderBy(order)))
    rows = rows.join(edges, F.col(log).eqNullSafe(F.col("_log")) & (F.col("_zone") == F.col("_z")), "left")
    return rows.withColumn(name, F.coalesce("_inside", "_edge")).drop("_zone", "_log", "_z", "_inside", "_edge")


def running(rows: DataFrame, log: str, order: str, **sums: Column) -> DataFrame:
    """rows plus, by name, the sum of a column over the log's rows up to each, itself included; ties of order by `id`.

    Zones of a log are summed apart, and a zone's sums follow the totals of the zones before it.
    """
    rows = rows.withColumn("_zone", F.floor(F.col(order) / ZONE)).withColumns({f"_of_{k}": v.cast("long") for k, v in sums.items()})
    before = Window.partitionBy(log).orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(log, "_zone").agg(*[F.sum(f"_of_{k}").alias(f"_all_{k}") for k in sums])
    totals = totals.select(F.col(log).alias("_log"), F.col("_zone").alias("_z"), *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_ahead_{k}") for k in sums])
    within = Window.partitionBy(log, "_zone").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"_of_{k}").over(within) for k in sums})
    rows = rows.join(totals, F.col(log).eqNullSafe(F.col("_log")) & (F.col("_zone") == F.col("_z")))
    return rows.withColumns({k: F.col(k) + F.col(f"_ahead_{k}") for k in sums}).drop("_zone", "_log", "_z", *[f"_of_{k}" for k in sums], *[f"_ahead_{k}" for k in sums])


def _followed(pointers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A zone's pointers by a: a, b, which of them each leads to next (itself where it leads out or ends), and where its path leaves."""
    pointers = pointers.sort_values("a")
    a, b = pointers["a"].to_numpy(np.int64), pointers["b"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    after = np.where(a[at] == b, at, np.arange(len(a))) if len(a) else at
    last = after
    for _ in range(len(a).bit_length()):
        last = last[last]
    return a, b, after, b[last]


def _shortened(key: tuple, pointers: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """(log, a, b): for each place where a path may enter the zone, where it leaves or ends."""
    a, _, _, out = _followed(pointers)
    mine = np.isin(a, entries["place"].to_numpy(np.int64))
    return pd.DataFrame({"log": key[0], "a": a[mine], "b": out[mine]})


def _walked(key: tuple, pointers: pd.DataFrame, entries: pd.DataFrame, size: int) -> pd.DataFrame:
    """(log, place): what is met in the zone of `size` places from where paths enter it."""
    a, b, after, _ = _followed(pointers)
    met, seen = set(entries["place"].tolist()), np.zeros(len(a), bool)
    for i in np.flatnonzero(np.isin(a, entries["place"].to_numpy(np.int64))):
        while not seen[i]:
            seen[i] = True
            met |= {int(a[i]), int(b[i])}
            i = after[i]
    return pd.DataFrame({"log": key[0], "place": sorted(p for p in met if p // size == key[1])})


def reachable(begins: DataFrame, jump: DataFrame, log: str) -> DataFrame:
    """(log, place): the places that pointers (log, a, b) lead to from where each log begins (log, place), these included; every place points to one at most.

    A zone of places is followed by one task, once to learn where the paths that enter it leave, and once from where they
    do enter. Between zones by doubling: each pass adds what lies as many pointers behind what is known as are known by
    then, so a path through n zones takes log n passes over the zones' entries alone.
    """
    size = POINTERS
    zone = lambda c: F.floor(F.col(c) / size)
    kind = begins.schema[log].dataType.simpleString()
    all_ = written(jump.select(F.col(log).alias("log"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "pointers")
    begins = begins.select(F.col(log).alias("log"), F.col("place").cast("long").alias("place"))
    entries = begins.unionByName(all_.filter(zone("a") != zone("b")).select("log", F.col("b").alias("place"))).distinct()
    by_zone = lambda rows, c: rows.filter("log is not null").withColumn("zone", zone(c)).groupBy("log", "zone")
    met = written(begins.distinct(), "reached")
    jump = written(by_zone(all_, "a").cogroup(by_zone(entries, "place")).applyInPandas(_shortened, f"log {kind}, a long, b long"), "pointers")
    while True:
        more = met.join(jump, (met["log"] == jump["log"]) & (met["place"] == jump["a"])).select(met["log"], F.col("b").alias("place"))
        if more.join(met, ["log", "place"], "left_anti").isEmpty():
            break
        met = written(met.unionByName(more).distinct(), "reached")
        step = jump.select(F.col("log").alias("_log"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        jump = written(jump.join(step, (F.col("log") == F.col("_log")) & (F.col("b") == F.col("_a"))).select("log", "a", F.col("_b").alias("b")), "pointers")
    walked = by_zone(all_, "a").cogroup(by_zone(met, "place")).applyInPandas(lambda key, pointers, entries: _walked(key, pointers, entries, size), f"log {kind}, place long")
    return written(walked.withColumnRenamed("log", log), "walked")
