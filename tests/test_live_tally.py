"""The tally over shuffled micro-batches and a restart against the batch fold."""

import json
import random

import pytest

from loomledger.operators.fold import Fold
from loomledger.streaming import live_tally
from loomledger.streaming.live_fold import unique_events
from tests.test_fold import SCHEMA, make, random_log


def run(spark, folder, horizon=None):
    """Both queries over what is there, to their end."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    first = live_tally.moves(events).writeStream.format("parquet").option("path", f"{folder}/moves").option("checkpointLocation", f"{folder}/cp1").outputMode("append").trigger(availableNow=True).start()
    first.awaitTermination()
    moves = spark.readStream.schema(live_tally.MOVE).option("maxFilesPerTrigger", 2).parquet(f"{folder}/moves")
    said = []
    if (folder / "said.json").exists():
        said = json.loads((folder / "said.json").read_text())

    def tell(df, n):
        said.extend((n, x.item, x.seq, x.event_id, x.voided, x.balance, x.late) for x in df.collect())

    second = live_tally.balances(moves, horizon).writeStream.foreachBatch(tell).option("checkpointLocation", f"{folder}/cp2").outputMode("append").trigger(availableNow=True).start()
    second.awaitTermination()
    (folder / "said.json").write_text(json.dumps(said))
    return said


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_and_a_restart_give_the_batch_fold(spark, tmp_path, seed):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    r = random.Random(seed)
    log = random_log(r, 120)
    shuffled = r.sample(log, len(log))
    for part in (shuffled[:50], shuffled[50:80], shuffled[80:], shuffled[:10]):  # the last ones come twice
        make(spark, part).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if part is not shuffled[80:]:
            said = run(spark, tmp_path)
    moves, tally = {}, {}
    for _, item, _, event, voided, balance, late in said:
        assert not late
        moves[event], tally[item] = (item, voided), balance
    f = Fold(make(spark, log))
    assert moves == {x.event_id: (x.item, x.voided) for x in f.tally_moves().collect()}
    want = {x.item: x.qty for x in f.tally().collect()}
    assert {k: v for k, v in tally.items() if v or k in want} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_deliveries_count_once(spark):
    log = random_log(random.Random(5), 20)
    assert unique_events(make(spark, log + log)).count() == 20


def test_what_is_sealed_leaves_the_state_and_late_moves_are_told():
    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    state, settle = State(), live_tally._item(10)
    frame = lambda *rows: iter([live_tally._frame([(s, f"m{s}", "x", q, q < 0, u) for s, q, u in rows], live_tally.MOVE)])
    out = [r for f in settle(("x",), frame((1, 5.0, None), (2, -9.0, None), (3, 4.0, 30), (25, -5.0, None)), state) for r in f.itertuples(index=False)]
    assert {r.event_id: (r.underflow, r.balance) for r in out} == {"m1": (False, 0.0), "m2": (True, 0.0), "m3": (False, 0.0), "m25": (False, 0.0)}
    held = json.loads(state.get[0])
    assert set(held["moves"]) == {"m3", "m25"} and (held["base"], held["sealed"]) == (5.0, 2)
    late = [r for f in settle(("x",), frame((2, 7.0, None), (26, 1.0, None)), state) for r in f.itertuples(index=False)]
    assert {r.event_id: bool(r.late) for r in late} == {"m2": True, "m26": False}
    assert late[-1].balance == 1.0
