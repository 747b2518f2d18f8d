"""Sync in chunks against the loops that it stands for, resuming from committed state, and pages against a reader."""

import random

import pytest

from loomledger.operators import chunks, neighbours, sync

EVENTS = "device_id string, seq long, id string"


def pushed_by_loop(pending, acked, unfit, size):
    """Outcomes per id and the cursor, chunk by chunk; pending in seq order."""
    out, cursor, k = {e: "unsent" for _, e in pending}, None, 0
    while k < len(pending):
        chunk = pending[k : k + size]
        whole = True
        for seq, e in chunk:
            if whole and e in acked:
                out[e], cursor = "dead" if e in unfit else "acked", seq
            else:
                whole, out[e] = False, "held"
        k += size
        if not whole:
            break
    return out, cursor


@pytest.mark.parametrize("zone", [1 << 20, 5])
def test_pushes_equal_the_loop(spark, monkeypatch, zone):
    monkeypatch.setattr(neighbours, "ZONE", zone)
    r = random.Random(5)
    logs = {f"d{k}": sorted(r.sample(range(1, 90), r.choice([1, 3, 9, 30, 41]))) for k in range(12)}
    rows = [(d, s, f"{d}-{s}") for d, seqs in logs.items() for s in seqs]
    acked = {e for *_, e in rows if r.random() < 0.96}
    unfit = {e for *_, e in rows if r.random() < 0.1}
    since = {d: r.choice([0, 0, 20]) for d in logs if r.random() < 0.7}
    table = lambda values, schema: spark.createDataFrame(list(values), schema)
    cursors = table(since.items(), "device_id string, since long")
    out = chunks.pushed(table(rows, EVENTS), table([(e, 7) for e in acked], "id string, server_time long"), cursors, table([(e,) for e in unfit], "id string"), size=4)
    got = {x.id: (x.outcome, x.server_time, x.sent) for x in out.collect()}
    totals = {x.device_id: x for x in chunks.push_summary(out, cursors).collect()}
    for d, seqs in logs.items():
        pending = [(s, f"{d}-{s}") for s in seqs if s > since.get(d, 0)]
        want, cursor = pushed_by_loop(pending, acked, unfit, 4)
        assert {e: got[e][0] for e in want} == want
        assert all(got[e][1:] == (7 if o != "unsent" and e in acked else None, o != "unsent") for e, o in want.items())
        if d in totals:
            count = lambda *o: sum(x in o for x in want.values())  # noqa: B023, E731
            assert (totals[d].pushed, totals[d].acked, totals[d].dead, totals[d].since) == (count("acked", "dead", "held"), count("acked"), count("dead"), cursor or since.get(d, 0))


def delta_by_loop(want, served, size):
    """Outcomes by place: chunks of the remainder, held ids in front, until two rounds in a row bring nothing."""
    out, stored, remainder, idle = {}, set(), list(want), 0
    while remainder and idle < 2:
        hold, before = [], len(remainder)
        for place, i in remainder[:size]:
            bad, kept = served.get(i, (None, None))
            if bad is None or (not bad and not kept):
                out[place] = "hold"
                hold.append((place, i))
            elif bad:
                out[place] = "poison"
            else:
                out[place] = "duplicate" if i in stored else "applied"
                stored.add(i)
        remainder = hold + remainder[size:]
        idle = idle + 1 if len(remainder) >= before else 0
    return {p: out.get(p, "left") for p, _ in want}, not remainder


@pytest.mark.parametrize("zone", [1 << 20, 4])
def test_delta_runs_equal_the_loop(spark, monkeypatch, zone):
    monkeypatch.setattr(neighbours, "ZONE", zone)
    r = random.Random(zone)
    want, served = {}, {}
    for k in range(14):
        ids = [f"i{r.randrange(60)}" for _ in range(r.choice([0, 1, 6, 40]))]
        want[f"d{k}"] = list(enumerate(ids))
        served[f"d{k}"] = {i: (r.random() < 0.15, r.random() < 0.9) for i in set(ids) if r.random() < 0.85}
    w = spark.createDataFrame([(d, p, i) for d, rows in want.items() for p, i in rows], "device_id string, place long, id string")
    s = spark.createDataFrame([(d, i, "bad" if bad else None, kept) for d, rows in served.items() for i, (bad, kept) in rows.items()], "device_id string, id string, poison_reason string, stored boolean")
    out = chunks.delta(w, s, size=5)
    got = {(x.device_id, x.place): x.outcome for x in out.collect()}
    done = {x.device_id: x.done for x in chunks.delta_summary(out).collect()}
    for d in want:
        outcomes, whole = delta_by_loop(want[d], served[d], 5)
        assert {p: got[d, p] for p in outcomes} == outcomes
        assert done.get(d, True) == whole


def test_delta_resumes_from_the_last_whole_generation(spark, tmp_path):
    state = chunks.State(spark, f"file://{tmp_path}/state")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    manifest = table([("d", k, f"i{k}") for k in range(6)], "device_id string, place long, id string")
    nothing = table([], "device_id string, id string")
    served = lambda ids, bad=(): table([("d", i, "bad" if i in bad else None, True) for i in ids], "device_id string, id string, poison_reason string, stored boolean")
    first, _ = chunks.delta_round(state, manifest, nothing, served(["i1", "i3"], bad=["i3"]), size=50)
    assert {x.id: x.outcome for x in first.collect()} == {"i0": "hold", "i1": "applied", "i2": "hold", "i3": "poison", "i4": "hold", "i5": "hold"}
    local = table([("d", "i1")], "device_id string, id string")
    more = manifest.unionByName(table([("d", -1, "i9")], "device_id string, place long, id string"))
    second, summary = chunks.delta_round(state, more, local, served([f"i{k}" for k in range(10)]), size=2)
    assert [(x.id, x.outcome) for x in second.orderBy("place").collect()] == [(i, "applied") for i in ("i0", "i2", "i4", "i5", "i9")]  # what was wanted before comes first, i3 is dead
    assert summary.first().done and state.generation() == 2
    # a run that has read an older generation may not commit
    assert not state.write({"want": nothing}, after=1) and state.generation() == 2


def test_push_and_pull_over_a_relay_with_losses_end_equal(spark):
    r = random.Random(3)
    rows = [(f"d{k % 2}", k // 2 + 1, f"e{k}") for k in range(40)]
    log = spark.createDataFrame(rows, EVENTS)
    relay = spark.createDataFrame([], EVENTS + ", pos long")
    cursors, unfit = spark.createDataFrame([], "device_id string, since long"), spark.createDataFrame([], "id string")
    for _ in range(9):
        lost = spark.createDataFrame([(e,) for *_, e in rows if r.random() < 0.05], "id string")
        acks = log.selectExpr("id", "0L server_time").join(lost, "id", "left_anti")
        out = chunks.pushed(log, acks, cursors, unfit, size=8)
        held, totals = chunks.stored(relay, out, lost).collect(), chunks.push_summary(out, cursors).collect()
        relay = spark.createDataFrame(held, EVENTS + ", pos long")
        cursors = spark.createDataFrame([(x.device_id, x.since) for x in totals], "device_id string, since long")
        if all(x.since == 20 for x in totals):
            break
    assert {x.id for x in held} == {e for *_, e in rows} and sorted(x.pos for x in held) == list(range(1, 41))
    for d in ("d0", "d1"):  # each device pulls what it lacks
        feeds = relay.selectExpr("0 relay", "pos", "id", "device_id", "seq")
        events, moved = sync.pulled_from_all(feeds, spark.createDataFrame([], "relay int, since long"))
        mine = log.filter(f"device_id = '{d}'").select("id")
        assert {x.id for x in events.join(mine, "id", "left_anti").collect()} | {x.id for x in mine.collect()} == {e for *_, e in rows}
        assert moved.first().since == 40


@pytest.mark.parametrize("zone", [1 << 20, 7])
def test_pages_equal_a_reader(spark, monkeypatch, zone):
    monkeypatch.setattr(neighbours, "ZONE", zone)
    r = random.Random(zone)
    feeds = {f"r{k}": [r.choice([1, 2, 5, 9, 14] + [21] * (k % 3 == 0 and r.random() < 0.1)) for _ in range(r.choice([1, 2, 30, 70]))] for k in range(8)}
    rows = [(name, 10 * p, f"{name}-{p}", "x" * n) for name, sizes in feeds.items() for p, n in enumerate(sizes)]
    got = {(x.relay, x.pos): (x.page, x.too_large) for x in sync.pages(spark.createDataFrame(rows, "relay string, pos long, id string, json string"), 4, 20).collect()}
    for name, sizes in feeds.items():
        want, at, page = {}, 0, 0
        while at < len(sizes):
            page, total, kept = page + 1, 0, 0
            for n in sizes[at : at + 4]:
                total += n
                if total > 20:
                    break
                kept += 1
            if not kept:
                want |= {p: (None, p == at) for p in range(at, len(sizes))}
                break
            want |= {p: (page, False) for p in range(at, at + kept)}
            at += kept
        assert {p: got[name, 10 * p] for p in range(len(sizes))} == want


def test_pointers_by_zones(spark, monkeypatch):
    """Paths that stay in a zone, cross zones both ways, begin without a pointer, end, or meet; and a path inside a zone costs no doubling."""
    import random

    from loomledger.operators import neighbours

    rng = random.Random(3)
    pointers = {(log, a): rng.choice([a + 1, a + 2, a + 5, a + 40]) for log in "xy" for a in range(300) if rng.random() < 0.97}
    pointers |= {("z", a): max(0, a - rng.choice([1, 2, 9])) for a in range(1, 200)}
    begins = [("x", 0), ("x", 7), ("y", 1), ("z", 199), ("z", 55), ("w", 4)]
    want = set()
    for log, place in begins:
        while (log, place) not in want:
            want.add((log, place))
            place = pointers.get((log, place), place)
    jump = spark.createDataFrame([(*k, b) for k, b in pointers.items()], "feed string, a long, b long")
    start = spark.createDataFrame(begins, "feed string, place long")
    made, write = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: made.append(name) or write(df, name))
    for zone in (8, 1 << 16):
        monkeypatch.setattr(neighbours, "POINTERS", zone)
        made.clear()
        got = [tuple(r) for r in neighbours.reachable(start, jump, "feed").collect()]
        assert sorted(got) == sorted(want)
    assert len(made) <= 6  # all in one zone
