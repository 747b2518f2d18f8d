"""A hot item folded in segments against one pass over its steps."""

import random

import pytest

from loomledger.operators import segments

STEPS = "item string, pos long, kind int, seq long, id string, qty double, remove boolean, first_undo long"


def steps_of(r, n, undo, most, fraction=1):
    """Steps of one item: removes as large as adds, so that many fall short; undos near and far behind their moves."""
    out = []
    for seq in range(1, n + 1):
        remove = r.random() < 0.56
        qty = r.randint(1, most) / fraction * (-1 if remove else 1)
        first = seq + r.choice([-3, 1, 5, n // 2]) if r.random() < undo else None
        out.append(("x", seq, 0, seq, f"m{seq}", qty, remove, first))
        if first is not None:
            out.append(("x", max(seq, first), 1, seq, f"m{seq}", qty, remove, first))
    return out


def in_one_pass(steps):
    balance, short, out = 0.0, set(), {}
    for _, _, kind, _, move, qty, remove, _ in sorted(steps, key=lambda s: (s[1], s[2])):
        if kind:
            balance -= 0 if move in short else qty
            continue
        under = remove and -qty > balance
        out[move] = (under, balance)
        if under:
            short.add(move)
        else:
            balance += qty
    return out


@pytest.mark.parametrize(("undo", "most", "fraction"), [(0.0, 9, 1), (0.2, 9, 1), (0.5, 100, 1), (0.3, 9, 7)])
def test_segments_equal_one_pass(spark, undo, most, fraction):
    r = random.Random(most)
    # no two moves are voided at one place, as no two undos share a seq
    steps, taken = [], set()
    for s in steps_of(r, 1200, undo, most, fraction):
        if s[2] and s[1] in taken:
            steps = [x[:7] + (None,) if x[4] == s[4] else x for x in steps]
            continue
        taken |= {s[1]} if s[2] else set()
        steps.append(s)
    other = [("y", s, 0, s, f"o{s}", 1.0, False, None) for s in range(4000, 4010)]
    got = {x.event_id: (x.underflow, x.on_hand) for x in segments.folded(spark.createDataFrame(steps + other, STEPS), segment=100).collect()}
    want = in_one_pass(steps)
    assert {k: v for k, v in got.items() if k[0] == "m"} == want
    assert len(got) == len(want) + 10 and sum(u for u, _ in want.values()) > 20


def test_one_item_of_many_moves_is_many_tasks_work(spark, monkeypatch):
    n, rounds = 200_000, []
    fold = segments._fold
    monkeypatch.setattr(segments, "_fold", lambda steps: rounds.append(steps.select("seg").distinct().count()) or fold(steps))
    rows = spark.range(1, n + 1).selectExpr("'x' item", "id pos", "0 kind", "id seq", "concat('m', id) id", "cast(if(hash(id) % 2 = 0, 1, -1) * (pmod(hash(id, 7), 50) + 1) as double) qty", "hash(id) % 2 <> 0 remove", "cast(null as long) first_undo")
    steps = [tuple(x) for x in rows.collect()]
    got = {x.event_id: (x.underflow, x.on_hand) for x in segments.folded(rows, segment=n // 32).collect()}
    assert got == in_one_pass(steps)
    assert rounds[0] == 32 and sum(rounds) < 32 * 8, rounds
