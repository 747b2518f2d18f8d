"""Which views a query builds, and how their names are compared."""

import json
from pathlib import Path

import pytest

from loomledger.operators import fold
from loomledger.session import Ledger
from loomledger.sources.scratch import run, shared_folder, written

ROWS = [(1, "a", "entry", {"value": 5}), (2, "b", "tally.add", {"item": "x", "qty": 2}), (3, "c", "undo.compensate", {"reverses": "zz"}), (4, "d", "entry", {"value": 7})]


@pytest.fixture
def ledger(spark):
    return Ledger(spark.createDataFrame([(s, i, t, "u", json.dumps(p)) for s, i, t, p in ROWS], "seq long, id string, type string, actor string, payload string"))


@pytest.mark.parametrize("name", ["entries", "ENTRIES", "Entries", "`entries`"])
def test_entries_are_read_without_folding_moves(ledger, monkeypatch, name):
    wrote = []
    monkeypatch.setattr(fold, "written", lambda df, what: wrote.append(what) or df)
    assert ledger.query(f"SELECT sum(value) AS s FROM {name} -- no tally, no records\nWHERE actor <> 'conflicts'").first().s == 12
    assert wrote == []
    assert [r.qty for r in ledger.query("SELECT qty FROM TALLY").collect()] == [2.0]
    assert wrote == ["moves"]


def test_stored_tables_go_with_their_run(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    written(spark.range(1), "kept")
    before = set(folder.iterdir())
    with run(spark):
        assert Ledger(spark.createDataFrame([(1, "a", "tally.add", "u", '{"item":"x","qty":2}')], "seq long, id string, type string, actor string, payload string")).query("SELECT qty FROM tally").first().qty == 2
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_views_are_found_in_subqueries_and_with_clauses(ledger):
    assert ledger.query("WITH t AS (SELECT * FROM Records) SELECT count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM _EVENTS)").first().n == 1
