"""The read-model as joins and aggregates: entries, tally, moves, conflicts and records of an ordered log.

Replaying event by event would be one task's work. What an event does to its
target depends only on sequence numbers, so undos and transitions are summed up
per target (partial aggregation, one shuffle) and joined to the events they
name, whether they came before or after them. Only the tally's underflow test
depends on every step before it; segments.py folds it, hot items in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.functions.payload import number_text
from loomledger.operators.segments import SEGMENT, folded
from loomledger.operators.validate import typed
from loomledger.schema import ADD, DOMAIN, ENTRY, REMOVE, TRANSITIONS, UNDO
from loomledger.sources.scratch import written


def _state_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, state in TRANSITIONS.items():
        out = F.when(kind == name, state).otherwise(out)
    return out


class Fold:
    """All views of one log; events need seq, id, type, actor and payload. Ids and seqs are unique among the fit events. segment: steps of an item that are folded as one."""

    def __init__(self, events: DataFrame, is_typed: bool = False, segment: int = SEGMENT) -> None:
        self._segment = segment
        self.typed = events if is_typed else written(typed(events), "typed_events")  # parsed once, read by every view
        self.events = self.typed.filter("poison_reason is null").drop("poison_reason")
        refs = self.events.filter(F.col("type").isin(UNDO, *TRANSITIONS))
        is_undo = F.col("type") == UNDO
        self._refs = refs.groupBy("target").agg(
            F.min(F.when(is_undo, F.col("seq"))).alias("first_undo"),
            F.min(F.when(~is_undo, F.col("seq"))).alias("first_step"),
            F.min_by(F.when(~is_undo, F.col("type")), F.when(~is_undo, F.col("seq"))).alias("step"),
        )
        self._moves: DataFrame | None = None
        domain = self.events.filter(F.col("type").isin(DOMAIN)).drop("target")
        self._domain = domain.join(self._refs, domain["id"] == self._refs["target"], "left").drop("target")

    def entries(self) -> DataFrame:
        """(seq, event_id, value, actor, state, voided)."""
        e = self._domain.filter(F.col("type") == ENTRY)
        return e.select(
            "seq", F.col("id").alias("event_id"), F.col("value").cast("long").alias("value"),
            F.coalesce("entry_actor", "actor").alias("actor"),
            F.coalesce(_state_of(F.col("step")), F.col("state")).alias("state"),
            F.col("first_undo").isNotNull().cast("int").alias("voided"),
        )

    def moves_in_full(self) -> DataFrame:
        """(seq, event_id, item, qty signed, voided, underflow, on_hand, first_undo); folded once and stored, since four views read it."""
        if self._moves is None:
            self._moves = written(self._folded(), "moves")
        return self._moves

    def _folded(self) -> DataFrame:
        m = self._domain.filter(F.col("type").isin(ADD, REMOVE))
        sign = F.when(F.col("type") == ADD, 1.0).otherwise(-1.0)
        m = m.select("seq", "id", "item", (sign * F.col("qty")).alias("qty"), (F.col("type") == REMOVE).alias("remove"), "first_undo")
        steps = m.withColumn("at", F.explode(F.when(F.col("first_undo").isNull(), F.array(F.struct(F.col("seq").alias("pos"), F.lit(0).alias("kind"))))
            .otherwise(F.array(F.struct(F.col("seq").alias("pos"), F.lit(0).alias("kind")), F.struct(F.greatest("seq", "first_undo").alias("pos"), F.lit(1).alias("kind"))))))
        steps = steps.select("item", "at.pos", "at.kind", "seq", "id", "qty", "remove", "first_undo")
        return folded(steps, self._segment).withColumn("voided", (F.col("underflow") | F.col("first_undo").isNotNull()).cast("int"))

    def tally_moves(self) -> DataFrame:
        return self.moves_in_full().select("seq", "event_id", "item", "qty", "voided")

    def tally(self) -> DataFrame:
        """(item, qty): running balances; an item that only underflowing removes name has none."""
        live = F.when(F.col("voided") == 0, F.col("qty")).otherwise(0.0)
        return self.moves_in_full().filter("not underflow").groupBy("item").agg(F.sum(live).alias("qty"))

    def conflicts(self) -> DataFrame:
        """(id, kind, detail, event_ids as JSON, status)."""
        t = self.events.filter(F.col("type").isin(*TRANSITIONS)).select("seq", "id", "type", "target")
        e = self._domain.filter(F.col("type") == ENTRY).select(F.col("id").alias("target"), F.col("seq").alias("entry_seq"), "first_step", _state_of(F.col("step")).alias("reached"))
        t = t.join(e, "target", "left")
        unknown, early, first = F.col("entry_seq").isNull(), F.col("seq") < F.col("entry_seq"), F.col("seq") == F.col("first_step")
        loser = ~unknown & ~first
        steps = t.filter(unknown | early | ~first).select(
            F.when(unknown | early, F.concat(F.lit("cf-"), "id", F.lit("-unknown-entry"))).otherwise(F.concat(F.lit("cf-"), "target", F.lit("-"), "id", F.lit("-double-resolve"))).alias("id"),
            F.when(loser, "double-resolve").otherwise("unknown-entry").alias("kind"),
            F.when(loser, F.concat("type", F.lit(" on already-terminal entry "), "target", F.lit(" ("), "reached", F.lit(")")))
            .otherwise(F.concat(F.lit("transition "), "type", F.lit(" references unknown entry "), "target")).alias("detail"),
            F.to_json(F.when(loser, F.array("target", "id")).otherwise(F.array("id"))).alias("event_ids"),
            F.when(~unknown & early & first, "resolved").otherwise("open").alias("status"),
        )
        short = self.moves_in_full().filter("underflow").select(
            F.concat(F.lit("cf-"), "event_id", F.lit("-underflow")).alias("id"),
            F.lit("underflow").alias("kind"),
            F.concat(F.lit("remove "), number_text(-F.col("qty")), F.lit("×"), "item", F.lit(" with "), number_text(F.col("on_hand")), F.lit(" on hand (event "), "event_id", F.lit(")")).alias("detail"),
            F.to_json(F.array("event_id")).alias("event_ids"),
            F.lit("open").alias("status"),
        )
        return steps.unionByName(short)

    def records(self) -> DataFrame:
        """(seq, event_id, type, body): events of other types, and undos that found nothing to void when they came."""
        known = self.events.filter(~F.col("type").isin(*DOMAIN, UNDO, *TRANSITIONS)).select("seq", F.col("id").alias("event_id"), "type", F.col("payload").alias("body"))
        undo = self.events.filter(F.col("type") == UNDO).select("seq", "id", "type", "payload", "target")
        e = self._domain.filter(F.col("type") == ENTRY).select(F.col("id").alias("target"), F.col("seq").alias("at"), F.lit(None).cast("long").alias("first_undo"), F.lit(False).alias("underflow"))
        m = self.moves_in_full().select(F.col("event_id").alias("target"), F.col("seq").alias("at"), "first_undo", "underflow")
        undo = undo.join(e.unionByName(m), "target", "left")
        parked = F.col("at").isNull() | (F.col("seq") < F.col("at")) | F.col("underflow") | F.coalesce(F.col("first_undo") < F.col("seq"), F.lit(False))
        return known.unionByName(undo.filter(parked).select("seq", F.col("id").alias("event_id"), "type", F.col("payload").alias("body")))


def rebuilt_tally(moves: DataFrame) -> DataFrame:
    """(item, qty) from moves alone; items without live moves are gone."""
    return moves.filter("voided = 0").groupBy("item").agg(F.sum("qty").alias("qty"))
