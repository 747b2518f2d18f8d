"""Hash chains: appending in order, and verification by comparing neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.functions.canonical import event_hash, hash_of, sorted_json
from loomledger.operators.neighbours import before
from loomledger.schema import GENESIS


def chained(events: DataFrame, log: str, tips: DataFrame | None = None) -> DataFrame:
    """events, renumbered from 1 within each log (column `log`) in seq order, with prev_hash and hash. tips: (log, max_seq, last_hash) of logs that go on.

    A hash needs the one before it, so a log is read in order; partitions hold many logs and only a tip is kept between rows.
    """
    kept = [c for c in events.columns if c not in ("prev_hash", "hash")]
    rows = events.select(*kept)
    if tips is not None:
        rows = rows.join(tips.select(F.col("log").alias(log), F.col("max_seq").alias("_from"), F.col("last_hash").alias("_tip")), log, "left")
    else:
        rows = rows.withColumns({"_from": F.lit(None).cast("long"), "_tip": F.lit(None).cast("string")})
    rows = rows.withColumns({"_from": F.coalesce("_from", F.lit(0)), "_tip": F.coalesce("_tip", F.lit(GENESIS))})

    heads = (log, "_from", "_tip", "id", "type", "actor", "device_id", "ts_device", "payload", "_sorted")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, tip = None, 0, GENESIS
        for batch in batches:
            seqs, prevs, hashes = [], [], []
            for name, start, base, id_, kind, actor, device, ts, payload, sorted_ in zip(*(batch.column(k).to_pylist() for k in heads), strict=True):
                if name != now:
                    now, seq, tip = name, start, base
                seq += 1
                prevs.append(tip)
                tip = hash_of({"id": id_, "seq": seq, "type": kind, "actor": actor, "device_id": device, "ts_device": ts, "payload": payload, "prev_hash": tip}, sorted_)
                seqs.append(seq)
                hashes.append(tip)
            own = {c: batch.column(c) for c in kept} | {"seq": pa.array(seqs, pa.int64()), "prev_hash": pa.array(prevs, pa.string()), "hash": pa.array(hashes, pa.string())}
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == 'seq' else f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    # payloads are put in order by all tasks, before each log goes to one
    ordered = rows.select(*kept, "_from", "_tip", sorted_json(F.col("payload")).alias("_sorted")).repartition(log).sortWithinPartitions(log, "seq")
    return ordered.mapInArrow(link, f"{schema}, prev_hash string, hash string")


def checked(events: DataFrame, log: str, order: str = "pos", gaps: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """events with `fault` (null: fine): every check needs only the row before, in file order.

    gaps: (log, seq) that quarantined lines left. markers: (log, truncated_before, tip) of logs whose start was swept; others start at 1 from GENESIS.
    """
    rows = before(events.withColumn("_hash", event_hash()), log, order, "_before", "hash", "seq")
    first, base = F.lit(1), F.lit(GENESIS)
    if markers is not None:
        m = markers.select(F.col(log).alias("_marked"), F.col("truncated_before").alias("_first"), F.col("tip").alias("_base"))
        rows = rows.join(m, F.col(log) == F.col("_marked"), "left").drop("_marked")
        first, base = F.coalesce("_first", first), F.coalesce("_base", base)
    rows = rows.withColumns({"_prev": F.coalesce("_before.hash", base), "_expect": F.coalesce(F.col("_before.seq") + 1, first)})
    if gaps is None:
        rows = rows.withColumn("_gap", F.lit(False))
    else:
        marks = gaps.select(log, "seq").distinct().withColumn("_gap", F.lit(True))
        rows = rows.join(marks, [log, "seq"], "left").withColumn("_gap", F.coalesce("_gap", F.lit(False)))
    # fixed values: what a fault is called
    fault = (
        F.when(F.col("_hash").isNull() | ~F.col("_hash").eqNullSafe(F.col("hash")), "hash mismatch (tampered payload?)")
        .when(F.col("seq") < F.col("_expect"), "duplicate seq (forked/edited log?)")
        .when((F.col("seq") > F.col("_expect")) & ~F.col("_gap"), "seq gap (truncated/edited log?)")
        .when(~F.col("prev_hash").eqNullSafe(F.col("_prev")) & ~F.col("_gap"), "prev_hash mismatch (truncated/edited log?)")
    )
    return rows.withColumn("fault", fault).drop("_hash", "_before", "_prev", "_expect", "_gap", "_first", "_base")


def verdicts(events: DataFrame, log: str, order: str = "pos", gaps: DataFrame | None = None, markers: DataFrame | None = None) -> DataFrame:
    """(log, ok, at, reason): each log's first fault in file order."""
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct(order, F.col("seq").alias("at"), F.col("fault").alias("reason"))))
    out = checked(events, log, order, gaps, markers).groupBy(log).agg(first.alias("f"))
    return out.select(log, F.col("f").isNull().alias("ok"), "f.at", "f.reason")
