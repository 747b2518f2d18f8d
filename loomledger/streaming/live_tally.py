"""The tally over a stream, in any order of arrival: two queries with keyed state, from ids to items, and from items to balances.

An undo names an event, not an item, so the first query keeps state per event id: a move, and the first undo that names
it, whichever comes first. Whenever either changes it hands on the move as it now stands. The second query keeps state
per item: its moves. Moves that come late, and undos that come to be known, may change the decisions of all later ones,
so what the state holds of the item is folded again, and every move whose decision is new is handed on, with the item's
balance. So the last row of each move and of each item is what the batch fold says of all events so far.

Both queries are restarted from their checkpoints; the folder between them is a file sink that is written exactly once.
With a `horizon`, moves that lie so many seqs behind the item's newest are taken for final and leave the state as one
balance; a change that comes later still is handed on as `late`, and not applied.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from loomledger.operators.validate import typed
from loomledger.schema import ADD, REMOVE, UNDO

MOVE = "seq long, id string, item string, qty double, remove boolean, first_undo long"
TOLD = "item string, seq long, event_id string, qty double, underflow boolean, voided int, balance double, late boolean"
_MOVE_STATE = "seq long, item string, qty double, remove boolean, first_undo long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names, kinds = zip(*[f.split() for f in schema.split(", ")], strict=True)
    as_kind = {"long": "Int64", "int": "Int32", "double": "float64", "boolean": "boolean", "string": "object"}
    return pd.DataFrame({n: pd.array([r[i] for r in rows], as_kind[k]) if k != "string" else [r[i] for r in rows] for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _targets(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One event id: its move and first undo, handed on when the move is known and either has changed."""
    was = state.get if state.exists else (None,) * 5
    seq, item, qty, remove, undo = was
    for pdf in batches:
        for s, kind, i, q in zip(pdf["seq"].tolist(), pdf["type"], pdf["item"], pdf["qty"].tolist(), strict=True):
            if kind == UNDO:
                undo = s if undo is None else min(undo, s)
            elif seq is None or s < seq:  # of an id that is delivered again the first place counts
                seq, item, qty, remove = s, i, q if kind == ADD else -q, kind == REMOVE
    now = (seq, item, qty, remove, undo)
    state.update(now)
    if seq is not None and now != was:
        yield _frame([(seq, key[0], item, qty, remove, undo)], MOVE)


def moves(events: DataFrame) -> DataFrame:
    """Streaming events to moves (MOVE), each again whenever an undo of it gets known. To be written to a file sink in append mode."""
    rows = typed(events).filter("poison_reason is null").filter(F.col("type").isin(ADD, REMOVE, UNDO))
    keyed = rows.select(F.when(F.col("type") == UNDO, F.col("target")).otherwise(F.col("id")).alias("key"), "seq", "type", "item", "qty")
    return keyed.groupBy("key").applyInPandasWithState(_targets, MOVE, _MOVE_STATE, "append", "NoTimeout")


def fold(balance: float, held: list[list]) -> tuple[float, dict[int, bool]]:
    """The balance after moves [seq, id, qty, remove, first_undo], and by seq whether each fell short."""
    steps = sorted([(m[0], 0, m) for m in held] + [(max(m[0], m[4]), 1, m) for m in held if m[4] is not None], key=lambda s: s[:2])
    short: dict[int, bool] = {}
    for _, voids, m in steps:
        if voids:
            balance -= 0 if short[m[0]] else m[2]
        else:
            short[m[0]] = bool(m[3]) and -m[2] > balance
            balance += 0 if short[m[0]] else m[2]
    return balance, short


def _item(horizon: int | None) -> Callable:
    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else {"base": 0.0, "sealed": None, "moves": {}, "told": {}}
        base, sealed, held, told = old["base"], old["sealed"], old["moves"], old["told"]
        out = []
        for pdf in batches:
            for seq, move, qty, remove, undo in zip(pdf["seq"].tolist(), pdf["id"], pdf["qty"].tolist(), pdf["remove"].tolist(), [None if pd.isna(x) else int(x) for x in pdf["first_undo"]], strict=True):
                if sealed is not None and seq <= sealed:
                    out.append((key[0], seq, move, qty, None, None, None, True))
                    continue
                known = held.get(move)
                if known is None or [seq, undo] != [known[0], known[4]]:
                    held[move] = [seq, move, qty, remove, min((u for u in (undo, known and known[4]) if u is not None), default=None)]
        balance, short = fold(base, list(held.values()))
        for move, m in held.items():
            now = [short[m[0]], int(short[m[0]] or m[4] is not None)]
            if told.get(move) != now:
                told[move] = now
                out.append((key[0], m[0], move, m[2], now[0], now[1], balance, False))
        if horizon is not None and held:
            edge = max(m[0] for m in held.values()) - horizon
            final = [m for m in held.values() if m[0] <= edge and (m[4] is None or m[4] <= edge)]
            # only a prefix that no kept move or undo reaches into is sealed
            edge = min([edge, *(m[0] - 1 for m in held.values() if m not in final)])
            final = [m for m in final if max(m[0], m[4] or 0) <= edge]
            if final and not any(m[0] <= edge for m in held.values() if m not in final):
                base, sealed = fold(base, final)[0], edge
                for m in final:
                    held.pop(m[1]), told.pop(m[1], None)
        state.update((json.dumps({"base": base, "sealed": sealed, "moves": held, "told": told}),))
        if out:
            yield _frame([(*r[:6], balance if not r[7] else None, r[7]) for r in out], TOLD)

    return settle


def balances(moves_: DataFrame, horizon: int | None = None) -> DataFrame:
    """Streaming moves (MOVE) to decisions (TOLD): each move's latest row counts, and each item's latest balance."""
    return moves_.groupBy("item").applyInPandasWithState(_item(horizon), TOLD, "held string", "append", "NoTimeout")
