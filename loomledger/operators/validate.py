"""What a payload says, and why an event may not enter the fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.functions import payload as p
from loomledger.functions.canonical import event_hash
from loomledger.schema import ADD, APPEND_STATES, ENTRY, HIDE, REMOVE, SHOW, TRANSITIONS, UNDO
from loomledger.sources.scratch import written


def typed(events: DataFrame) -> DataFrame:
    """events with the payload's fields and `poison_reason` (null: fit to fold); the payload is parsed once."""
    kind, v = F.col("type"), F.col("_v")
    tally = kind.isin(ADD, REMOVE)
    rows = events.withColumn("_v", F.try_parse_json("payload"))
    rows = rows.withColumns({"_n": F.when(kind == ENTRY, p.field(v, "value")).when(tally, p.field(v, "qty")), "_i": F.when(tally, p.field(v, "item"))})
    rows = rows.withColumns({"_nk": p.kind_of(F.col("_n")), "_nt": F.trim(F.col("_n").try_cast("string")), "_ik": p.kind_of(F.col("_i")), "_it": F.col("_i").try_cast("string")})
    rows = rows.withColumns({"_num": p.number(F.col("_nk"), F.col("_nt")), "_object": p.kind_of(v).startswith("OBJECT")})
    rows = rows.select(
        *events.columns,
        "_object",
        F.when(kind == ENTRY, F.col("_num")).alias("value"),
        F.when(kind == ENTRY, F.coalesce(p.optional(v, "state"), F.lit("RECORDED"))).alias("state"),
        F.when(kind == ENTRY, p.optional(v, "actor")).alias("entry_actor"),
        F.when(tally, p.string(F.col("_ik"), F.col("_it"))).alias("item"),
        F.when(tally, F.col("_num")).alias("qty"),
        F.when(kind == UNDO, F.coalesce(p.optional(v, "reverses"), F.lit("")))
        .when(kind.isin(*TRANSITIONS), F.coalesce(p.optional(v, "event_id", "reverses"), F.lit("")))
        .when(kind == HIDE, p.optional(v, "hides"))
        .when(kind == SHOW, p.optional(v, "shows")).alias("target"),
    )
    whole = F.coalesce((F.col("value") == F.floor("value")) & (F.col("value") > 0) & (F.abs("value") < float("inf")), F.lit(False))
    finite = F.coalesce(~F.isnan("qty") & (F.abs("qty") < float("inf")), F.lit(False))
    reason = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "event without id")
        .when(kind.isNull() | (kind == ""), "event without type")
        .when(~F.coalesce("_object", F.lit(False)), "payload must be an object")
        .when((kind == ENTRY) & ~whole, "entry rejected: value must be a positive integer")
        .when((kind == ENTRY) & ~F.col("state").isin(APPEND_STATES), "entry rejected: state cannot be recorded offline")
        .when((kind == ADD) & ((F.col("item") == "") | ~finite), "tally.add needs {item, qty}")
        .when((kind == REMOVE) & ((F.col("item") == "") | ~finite | (F.col("qty") <= 0)), "tally.remove needs {item, qty>0}")
    )
    return rows.withColumn("poison_reason", reason).drop("_object")


def gated(rows: DataFrame, swept_ids: DataFrame) -> DataFrame:
    """typed rows whose `poison_reason` also tells ids that were excised and must not come back, and hashes that do not fit (only such as are 64 hex digits)."""
    gone = swept_ids.select(F.col("id").alias("_swept")).distinct()
    rows = rows.join(gone, F.col("id") == F.col("_swept"), "left")
    wrong = F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$") & (event_hash() != F.col("hash")), F.lit(False))
    # fixed values: what a refusal is called
    reason = (
        F.when(F.col("_swept").isNotNull(), F.concat(F.lit("swept id reused: "), "id", F.lit(" was excised and must not be re-appended")))
        .when(wrong, F.concat(F.lit("tamper rejected: hash mismatch for event "), "id", F.lit(" (seq "), F.col("seq").cast("string"), F.lit(")")))
    )
    return rows.withColumn("poison_reason", F.coalesce("poison_reason", reason)).drop("_swept")


def corrupt(events: DataFrame) -> DataFrame:
    """(event_id, reason) of stored events whose payload is no JSON object; their rows leave the views like a quarantined event's."""
    bad = ~F.coalesce(p.kind_of(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    return events.filter(bad).select(F.col("id").alias("event_id"), F.concat(F.lit("corrupt-payload seq="), F.col("seq").cast("string")).alias("reason"))


def accepted(rows: DataFrame) -> DataFrame:
    """typed rows with `disposition`: applied, duplicate (a known id again), collision (a new id on a taken seq) or poison.

    As if read one by one by seq, then id: a row is applied if neither its id nor
    its seq has been. Only rows that share an id or a seq take part in the rounds:
    each applies those that come first under both keys and sets aside what shares
    a key with them, which by then cannot be applied.
    """
    all_rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "arrivals")
    fit = all_rows.filter("poison_reason is null").select("id", "seq", F.struct("seq", "id", "_row").alias("place"))
    keys = ("id", "seq")
    first = {k: (lambda df, k=k: df.groupBy(k).agg(F.min("place").alias(f"_{k}"), F.count("*").alias(f"_n_{k}"))) for k in keys}
    sides = lambda df: df.join(first["id"](df), "id").join(first["seq"](df), "seq")
    ranked = written(sides(fit), "arrivals")
    alone = (F.col("_n_id") == 1) & (F.col("_n_seq") == 1)
    won = [ranked.filter(alone).select("id", "seq", "place")]
    still = ranked.filter(~alone)
    while not still.isEmpty():
        winners = written(still.filter((F.col("place") == F.col("_id")) & (F.col("place") == F.col("_seq"))).select("id", "seq", "place"), "arrivals")
        won.append(winners)
        rest = still.select("id", "seq", "place").join(winners.select("id"), "id", "left_anti").join(winners.select("seq"), "seq", "left_anti")
        still = written(sides(written(rest, "arrivals")), "arrivals")
    applied = reduce(DataFrame.unionByName, won).select(F.col("id").alias("_won"), F.col("place._row").alias("_by"), F.col("place").alias("_place"))
    out = all_rows.join(applied, F.col("id") == F.col("_won"), "left")
    later = F.struct("seq", "id", "_row") > F.col("_place")
    word = F.when(F.col("poison_reason").isNotNull(), "poison").when(F.col("_row") == F.col("_by"), "applied").when(later, "duplicate").otherwise("collision")
    return out.withColumn("disposition", word).drop("_row", "_won", "_by", "_place")
