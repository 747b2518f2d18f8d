"""The entry fold over a stream: what an undo or a transition does to its target, whichever comes first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomledger.operators.validate import typed
from loomledger.schema import ENTRY, TRANSITIONS, UNDO


def live_entries(events: DataFrame) -> DataFrame:
    """Complete-mode state per entry id: value, state, voided. State has no time limit, since an undo may come before its target at any distance."""
    rows = typed(events).filter("poison_reason is null").filter(F.col("type").isin(ENTRY, UNDO, *TRANSITIONS))
    key = F.when(F.col("type") == ENTRY, F.col("id")).otherwise(F.col("target"))
    step = F.when(F.col("type").isin(*TRANSITIONS), F.struct("seq", "type"))
    out = rows.groupBy(key.alias("event_id")).agg(
        F.max("value").cast("long").alias("value"), F.max("state").alias("state"), F.min(step).alias("step"), F.max((F.col("type") == UNDO).cast("int")).alias("voided")
    )
    reached = F.lit(None).cast("string")
    for name, state in TRANSITIONS.items():
        reached = F.when(F.col("step.type") == name, state).otherwise(reached)
    return out.filter("value is not null").select("event_id", "value", F.coalesce(reached, "state").alias("state"), "voided")


def unique_events(events: DataFrame) -> DataFrame:
    """Each id once, however often and late it is delivered."""
    return events.dropDuplicates(["id"])
