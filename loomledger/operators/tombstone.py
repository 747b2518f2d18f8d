"""Soft deletes, legal holds, and the largest seal that a truncation may use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.neighbours import reachable
from loomledger.schema import HIDE, SHOW
from loomledger.sources.scratch import written


def operations(events: DataFrame) -> DataFrame:
    """(seq, event_id, op, target) of well-formed hides and shows; events are typed."""
    ok = F.col("type").isin(HIDE, SHOW) & F.col("target").isNotNull() & (F.col("target") != "")
    return events.filter(ok).select("seq", F.col("id").alias("event_id"), F.substring_index("type", ".", -1).alias("op"), "target")


def hidden_ids(events: DataFrame) -> DataFrame:
    """(target): those whose last operation hides them."""
    last = operations(events).groupBy("target").agg(F.max_by("op", "seq").alias("op"))
    return last.filter("op = 'hide'").select("target")


def holds(held: DataFrame, events: DataFrame) -> DataFrame:
    """(id, reason, seq): every hold with its event's seq, null where the event is not stored."""
    return held.join(events.select("id", "seq"), "id", "left").select("id", "reason", "seq")


def first_unapplied(log: DataFrame, stored: DataFrame) -> int | None:
    """Least logged seq that the read-model does not have."""
    return log.select("seq").join(stored.select("seq"), "seq", "left_anti").agg(F.min("seq")).first()[0]


def pairs(events: DataFrame) -> DataFrame:
    """(lo, hi): for each operation whose target is stored, the seals that would part the two."""
    ops = operations(events).select("seq", "target")
    both = ops.join(events.select(F.col("id").alias("target"), F.col("seq").alias("target_seq")), "target").filter("seq <> target_seq")
    return both.select(F.least("seq", "target_seq").alias("lo"), (F.greatest("seq", "target_seq") - 1).alias("hi"))


def islands(intervals: DataFrame) -> DataFrame:
    """(lo, hi): the intervals merged where they touch; ranges of seqs are merged apart first, and the last window sees only islands at a range's border, at most two each."""
    width = 1 << 20
    cut = intervals.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("zone"))
    cut = cut.select("zone", F.greatest("lo", F.col("zone") * width).alias("lo"), F.least("hi", (F.col("zone") + 1) * width - 1).alias("hi"))
    local = _merged(cut, ["zone"])
    border = (F.col("lo") == F.col("zone") * width) | (F.col("hi") == (F.col("zone") + 1) * width - 1)
    across = _merged(local.filter(border).drop("zone").withColumn("all", F.lit(0)), ["all"]).drop("all")
    return local.filter(~border).drop("zone").unionByName(across)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    rows = rows.withColumn("_end", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(F.col("_end").isNull() | (F.col("lo") > F.col("_end") + 1), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def _clamped(events: DataFrame, log: DataFrame, sealed: int, ack: int) -> int:
    seal = min(sealed, ack)
    gap = first_unapplied(log.filter(F.col("seq") <= seal), events)
    return seal if gap is None else min(seal, gap - 1)


def guard_seal(events: DataFrame, log: DataFrame, held: DataFrame, sealed: int, ack: int) -> int:
    """The largest seal up to min(sealed, ack) that sweeps nothing unapplied or held and parts no operation from its target."""
    seal = _clamped(events, log, sealed, ack)
    low = holds(held, events).filter(F.col("seq") <= seal).agg(F.min("seq")).first()[0]
    seal = seal if low is None else low - 1
    inside = islands(pairs(events)).filter((F.col("lo") <= seal) & (F.col("hi") >= seal)).agg(F.min("lo")).first()[0]
    return max(0, seal if inside is None else inside - 1)


def guard(events: DataFrame, log: DataFrame, held: DataFrame, sealed: int, ack: int) -> tuple[int, DataFrame, list[tuple[int, int]]]:
    """The seal of guard_seal() and what forced it down: holds with `blocks`, and the pairs (target's seq, operation's seq) that a seal on the way would have parted.

    A hold blocks if it lies at or below the seal that those of earlier ids left. Of several parted pairs the
    earliest operation's moves the seal; only the island around the seal is searched.
    """
    clamp = _clamped(events, log, sealed, ack)
    w = Window.partitionBy("_all").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = holds(held, events).withColumn("_all", F.lit(0))  # holds are set by hand, one by one
    left = F.least(F.lit(clamp), F.coalesce(F.min(F.when(F.col("seq") <= clamp, F.col("seq"))).over(w) - 1, F.lit(clamp)))
    blocked = rows.withColumn("blocks", F.coalesce(F.col("seq") <= left, F.lit(False))).drop("_all")
    low = blocked.filter("blocks").agg(F.min("seq")).first()[0]
    seal = clamp if low is None else low - 1
    effective = guard_seal(events, log, held, sealed, ack)
    if effective >= seal:
        return effective, blocked, []
    ops = operations(events).select(F.col("seq").alias("op_seq"), "target")
    both = ops.join(events.select(F.col("id").alias("target"), F.col("seq").alias("target_seq")), "target").select("target_seq", "op_seq")
    near = written(both.filter((F.least("target_seq", "op_seq") <= seal) & (F.greatest("target_seq", "op_seq") > effective)), "island")
    return effective, blocked, [(r["target_seq"], r["op_seq"]) for r in parted(near, seal, effective).orderBy(F.desc("seal")).collect()]


def parted(pairs: DataFrame, seal: int, effective: int) -> DataFrame:
    """(seal, target_seq, op_seq): the pairs that move a seal, one after the other, from `seal` down: of those it parts the earliest operation's, below whose lesser seq it comes to lie next.

    A pair is parted by the seals between its seqs. That range is cut into dyadic blocks, at most two a level, and each
    seal lies in one block a level; so for every seal that may come up its pair is found by one join, and where they lead by doubling.
    """
    lo, hi = F.least("target_seq", "op_seq"), F.greatest("target_seq", "op_seq")
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(1, seal.bit_length()))))
    size = F.expr("shiftleft(1L, level)")
    rows = pairs.withColumns({"lo": lo, "hi": F.least(hi, F.lit(seal + 1))}).filter("lo < hi").withColumn("level", levels)
    rows = rows.withColumns({"left": F.ceil(F.col("lo") / size), "right": F.floor(F.col("hi") / size)}).filter("left < right")
    ends = F.filter(F.array(F.when(F.col("left") % 2 == 1, F.col("left")), F.when(F.col("right") % 2 == 1, F.col("right") - 1)), lambda x: x.isNotNull())
    blocks = rows.withColumn("block", F.explode(ends)).groupBy("level", "block").agg(F.min(F.struct("op_seq", "target_seq")).alias("first"))
    seals = pairs.select(F.greatest(F.lit(0), lo - 1).alias("seal")).filter(F.col("seal").between(effective, seal)).unionByName(pairs.sparkSession.createDataFrame([(seal,)], "seal long")).distinct()
    within = seals.withColumn("level", levels).withColumn("block", F.floor(F.col("seal") / size))
    moved = within.join(blocks, ["level", "block"]).groupBy("seal").agg(F.min("first").alias("p")).filter(F.col("seal") > effective)
    moved = written(moved.select("seal", "p.target_seq", "p.op_seq"), "moved_seals")
    jump = moved.select(F.lit(0).alias("all"), F.col("seal").alias("a"), F.greatest(F.lit(0), F.least("target_seq", "op_seq") - 1).alias("b"))
    begin = pairs.sparkSession.createDataFrame([(0, seal)], "all int, place long")
    return moved.join(reachable(begin, jump, "all").select(F.col("place").alias("seal")), "seal").select("seal", "target_seq", "op_seq")


def planned(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests (id, op: hide or show) with what is to be done: `error`, or `existing` (the first hide, if it is hidden already), or a new event's `type` and `payload`."""
    stored = events.select("id").distinct().withColumn("_stored", F.lit(True))
    hidden = hidden_ids(events).select(F.col("target").alias("id"), F.lit(True).alias("_hidden"))
    first = operations(events).filter("op = 'hide'").groupBy(F.col("target").alias("id")).agg(F.min_by("event_id", "seq").alias("_first"))
    rows = requests.join(stored, "id", "left").join(hidden, "id", "left").join(first, "id", "left")
    hide = F.col("op") == "hide"
    error = F.when(hide & F.col("_stored").isNull(), F.concat(F.lit("ERR_UNKNOWN_TARGET: tombstone.hide needs a stored event id (got "), "id", F.lit(")"))).when(
        ~hide & F.col("_hidden").isNull(), F.concat(F.lit("ERR_NOT_HIDDEN: tombstone.show needs a hidden event id (got "), "id", F.lit(")"))
    )
    rows = rows.withColumn("error", error).withColumn("existing", F.when(hide & F.col("error").isNull() & F.col("_hidden"), F.col("_first")))
    new = F.col("error").isNull() & F.col("existing").isNull()
    payload = F.to_json(F.when(hide, F.struct(F.col("id").alias("hides"), F.lit(None).cast("string").alias("shows"))).otherwise(F.struct(F.lit(None).cast("string").alias("hides"), F.col("id").alias("shows"))))
    return rows.select("id", "op", "error", "existing", F.when(new, F.when(hide, HIDE).otherwise(SHOW)).alias("type"), F.when(new, payload).alias("payload"))


def held_after(held: DataFrame, set_: DataFrame, released: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holds, refused): holds (id, reason) with new ones set and some released; a hold of an event that is not stored is refused."""
    known = events.select("id").distinct()
    refused = set_.join(known, "id", "left_anti").select("id", F.concat(F.lit("ERR_UNKNOWN_TARGET: hold needs a stored event id (got "), "id", F.lit(")")).alias("error"))
    new = set_.join(known, "id", "left_semi").dropDuplicates(["id"]).select("id", "reason")
    old = held.join(new.select("id"), "id", "left_anti").select("id", "reason")
    return old.unionByName(new).join(released.select("id"), "id", "left_anti"), refused


def is_held(held: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with `held`."""
    return ids.join(held.select("id").distinct().withColumn("_held", F.lit(True)), "id", "left").select("id", F.coalesce("_held", F.lit(False)).alias("held"))
