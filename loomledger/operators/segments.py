"""The tally's underflow test over items of any size: segments of a hot item are folded from guessed balances.

Whether a remove falls short depends on the balance before it, and so on every decision before. But of a segment of
steps it is only the balance it starts from that matters: its fold tells between which starts (low <= start < high) all
its decisions stay as they are, and then it adds the same net change to any of them. So all segments of an item are
folded at once, each from the balance that it would start from if every remove were granted but for those that would
lead below zero. Then the true starts are running sums of the net changes, and only segments that these take out of
their bounds are folded again, from the new start, until none is. The first segment starts from 0, so each round makes
at least one more segment final; most hot items take a few rounds.

An undo whose move stands in an earlier segment takes effect unless that move fell short. It is first taken to have been
granted; a segment in which that turns out wrong is folded again too.

Shifting a start is exact where all quantities are whole and their sum is below 2^53. Items with other quantities, and
items of at most `segment` steps, are one segment, read in order as a stream with one balance as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.sources.scratch import written

#: Steps of a segment, on average; and rows up to which a table is broadcast.
SEGMENT = 1 << 16
BROADCAST_ROWS = 500_000

_INF = float("inf")
_MOVES = {"item": pa.string(), "seg": pa.int64(), "seq": pa.int64(), "event_id": pa.string(), "qty": pa.float64(), "underflow": pa.bool_(), "delta": pa.float64(), "first_undo": pa.int64()}
_SUMS = {"start": pa.float64(), "net": pa.float64(), "low": pa.float64(), "high": pa.float64()}
_OUT = "item string, seg long, seq long, event_id string, qty double, underflow boolean, delta double, first_undo long, start double, net double, low double, high double"
_STEP = ("item", "seg", "start", "kind", "seq", "id", "qty", "remove", "first_undo", "away", "fell_short")


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted steps of whole segments: a row a move, and behind a segment's moves a row with its sums."""
    now, start, delta, low, high, short = None, 0.0, 0.0, -_INF, _INF, set()

    def sums() -> tuple:
        return (*now, None, None, None, None, None, None, start, delta, low, high)

    for batch in batches:
        out = []
        for item, seg, begin, kind, seq, move, qty, remove, first_undo, away, fell_short in zip(*(batch.column(c).to_pylist() for c in _STEP), strict=True):
            if (item, seg) != now:
                if now:
                    out.append(sums())
                now, start, delta, low, high, short = (item, seg), begin, 0.0, -_INF, _INF, set()
            if kind:
                if away:
                    delta -= 0.0 if fell_short else qty
                elif move in short:
                    short.discard(move)
                else:
                    delta -= qty
                continue
            under = remove and -qty > start + delta
            if under:
                high = min(high, -qty - delta)
                if first_undo is not None:
                    short.add(move)
            elif remove:
                low = max(low, -qty - delta)
            out.append((item, seg, seq, move, qty, under, delta, first_undo, None, None, None, None))
            if not under:
                delta += qty
        yield _batch(out)
    if now:
        yield _batch([sums()])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = _MOVES | _SUMS
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True)], list(kinds))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _fold(steps: DataFrame) -> DataFrame:
    ordered = steps.select(*_STEP, "pos").repartition("item", "seg").sortWithinPartitions("item", "seg", "pos", "kind")
    return written(ordered.select(*_STEP).mapInArrow(_folding, _OUT), "segments")


def folded(steps: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(seq, event_id, item, qty, underflow, on_hand, first_undo) of every move.

    steps: item, pos, kind (0 a move, 1 what voids it), seq and id of the move, qty signed, remove, first_undo.
    """
    whole = F.bool_and(F.col("qty") == F.floor("qty")) & (F.sum(F.abs("qty")) < float(1 << 53))
    stats = steps.groupBy("item").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), whole.alias("whole")).filter(F.col("whole") & (F.col("n") > segment))
    width = F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first") + 1) / F.col("n") * segment))
    hot = written(stats.select("item", "first", width.alias("width")), "hot_items")
    alone = steps.withColumns({"seg": F.lit(0).cast("long"), "start": F.lit(0.0), "away": F.lit(False), "fell_short": F.lit(False)})
    moves = lambda df: df.filter("net is null").select("seq", "event_id", "item", "qty", "underflow", (F.col("begin") + F.col("delta")).alias("on_hand"), "first_undo")
    if hot.isEmpty():
        return moves(_fold(alone).withColumn("begin", F.lit(0.0)))

    at = lambda place: F.coalesce(F.floor((F.col(place) - F.col("first")) / F.col("width")), F.lit(0))
    cut = steps.join(_sized(hot), "item", "left").withColumns({"seg": at("pos"), "away": (F.col("kind") == 1) & (at("seq") < at("pos"))}).drop("first", "width")
    cut = written(cut, "hot_steps")
    place = Window.partitionBy("item").orderBy("seg")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    # what would be there if all were granted, never below zero
    net = cut.groupBy("item", "seg").agg(F.sum(F.when(F.col("kind") == 0, F.col("qty")).otherwise(-F.col("qty"))).alias("net"))
    ahead = net.withColumn("sum", F.coalesce(F.sum("net").over(before), F.lit(0.0)))
    starts = ahead.select("item", "seg", (F.col("sum") - F.least(F.lit(0.0), F.min("sum").over(place))).alias("start"))
    away = written(cut.filter("away").select("item", "seg", F.col("id").alias("event_id"), F.lit(False).alias("taken")), "away_undos")

    todo = written(starts, "segment_starts")
    now = None
    while True:
        rows = cut.join(_sized(todo), ["item", "seg"])
        if now is None:
            rows = rows.withColumn("fell_short", F.lit(False))
        else:
            rows = rows.join(_sized(away.filter("taken").select("item", "seg", F.col("event_id").alias("id"), F.lit(True).alias("_short"))), ["item", "seg", "id"], "left").withColumn("fell_short", F.col("away") & F.coalesce("_short", F.lit(False)))
        fresh = _fold(rows)
        now = fresh if now is None else written(now.join(_sized(todo.select("item", "seg")), ["item", "seg"], "left_anti").unionByName(fresh), "segments")
        sums = now.filter("net is not null").select("item", "seg", "net", "low", "high").withColumn("begin", F.coalesce(F.sum("net").over(before), F.lit(0.0)))
        sums = written(sums, "segment_sums")
        told = now.filter("underflow and first_undo is not null").select("item", "event_id", F.lit(True).alias("_fell"))
        seen = written(away.join(told, ["item", "event_id"], "left").select("item", "seg", "event_id", "taken", F.coalesce("_fell", F.lit(False)).alias("fell")), "away_undos")
        wrong = seen.filter("taken <> fell").select("item", "seg").distinct().withColumn("_wrong", F.lit(True))
        todo = sums.join(wrong, ["item", "seg"], "left").filter("begin < low or begin >= high or _wrong").select("item", "seg", F.col("begin").alias("start"))
        todo = written(todo, "segment_starts")
        away = seen.select("item", "seg", "event_id", F.col("fell").alias("taken"))
        if todo.isEmpty():
            return moves(now.join(sums.select("item", "seg", "begin"), ["item", "seg"]))
