import json
import random

import pytest

from loomledger.operators.fold import Fold
from loomledger.operators.validate import accepted, typed
from loomledger.session import Ledger
from loomledger.sources.scratch import written
from tests.model import Model

SCHEMA = "seq long, id string, type string, actor string, device_id string, ts_device long, payload string"


def make(spark, events):
    return spark.createDataFrame([(s, i, t, "a", "d", 0, p if isinstance(p, str) else json.dumps(p)) for s, i, t, p in events], SCHEMA)


def random_log(r, n):
    out = []
    for s in range(1, n + 1):
        t = r.choice(["entry", "entry", "tally.add", "tally.remove", "tally.remove", "undo.compensate", "undo.compensate", "entry.resolved", "entry.failed", "note"])
        target = f"e{r.randint(1, n + 3)}"
        p = {"entry": {"value": r.randint(1, 9)}, "tally.add": {"item": r.choice("xyz"), "qty": r.randint(-2, 9)}, "tally.remove": {"item": r.choice("xyz"), "qty": r.randint(1, 9)},
             "undo.compensate": {"reverses": target}, "note": {"a": 1}}.get(t, {"event_id": target})
        out.append((s, f"e{s}", t, p))
    return out


@pytest.mark.parametrize(("seed", "segment"), [(0, 1 << 16), (1, 1 << 16), (2, 6), (3, 11)])
def test_fold_equals_sequential_model(spark, seed, segment):
    r = random.Random(seed)
    log = random_log(r, 150)
    model = Model()
    for e in log:
        model.apply(*e)
    f = Fold(make(spark, log), segment=segment)
    assert {x.event_id: (x.state, x.voided) for x in f.entries().collect()} == {k: (v["state"], v["voided"]) for k, v in model.entries.items()}
    assert {x.event_id: (x.item, x.qty, x.voided) for x in f.tally_moves().collect()} == {k: (v["item"], v["qty"], v["voided"]) for k, v in model.moves.items()}
    assert {x.item: x.qty for x in f.tally().collect()} == model.tally
    assert {x.id: (x.kind, x.status) for x in f.conflicts().collect()} == model.conflicts
    assert sorted(x.event_id for x in f.records().collect()) == sorted(model.records)


def test_unfit_events_stay_out(spark):
    cases = [("entry", {"value": "5000"}, True), ("entry", {"value": True}, True), ("entry", {"value": ""}, False), ("entry", {"value": 1.5}, False), ("entry", {}, False), ("entry", {"value": 1, "state": "FAILED"}, False),
             ("entry", {"value": "0x10"}, True), ("entry", {"value": "5d"}, False), ("tally.add", {"item": "a", "qty": -1.5}, True), ("tally.add", {"item": "", "qty": 1}, False), ("tally.remove", {"item": "a", "qty": 0}, False),
             ("note", "5", False), ("note", "{", False), ("", {}, False)]
    rows = typed(make(spark, [(i, f"e{i}", t, p) for i, (t, p, _) in enumerate(cases)])).collect()
    assert [r.poison_reason is None for r in sorted(rows, key=lambda r: r.seq)] == [ok for *_, ok in cases]


def test_clashes(spark):
    log = [(1, "a", "note", {}), (2, "a", "note", {}), (3, "b", "note", {}), (3, "c", "note", {}), (4, "d", "entry", {"value": 0})]
    out = {(r.seq, r.id): r.disposition for r in accepted(written(typed(make(spark, log)), "t")).collect()}
    assert out == {(1, "a"): "applied", (2, "a"): "duplicate", (3, "b"): "applied", (3, "c"): "collision", (4, "d"): "poison"}


def test_query_parameters_and_writes(spark):
    ledger = Ledger(make(spark, [(1, "e1", "entry", {"value": 7}), (2, "e2", "entry", {"value": 5})]))
    assert ledger.query("SELECT value FROM entries WHERE event_id = $id", {"id": "e2"}).collect()[0][0] == 5
    assert ledger.query("SELECT value FROM entries WHERE seq = ?", [1]).collect()[0][0] == 7
    with pytest.raises(ValueError):
        ledger.query("DELETE FROM entries")
    assert ledger.query("SELECT SUM(value) AS s FROM entries WHERE voided = 1").collect()[0].s is None
