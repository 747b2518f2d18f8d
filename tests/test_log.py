import json

from pyspark.sql import functions as F

from loomledger.functions.canonical import canonical_json, event_hash, hash_of, number_json
from loomledger.operators import chain, revoke, tombstone
from loomledger.operators.validate import typed
from loomledger.sources import log
from loomledger.sources.scratch import written


def make_log(n):
    out, tip = [], "GENESIS"
    for s in range(1, n + 1):
        e = {"id": f"e{s}", "seq": s, "type": "entry", "actor": None, "device_id": "d", "ts_device": 1000 + s, "payload": {"value": s, "b": {"z": "é", "a": [1, None, True]}}, "prev_hash": tip}
        tip = hash_of(e | {"payload": json.dumps(e["payload"])})
        out.append(json.dumps(e | {"hash": tip}, ensure_ascii=False))
    return out


def test_scan_recovers_and_verifies(spark, tmp_path):
    lines = make_log(8)
    lines[4] = lines[4][:20] + "\x01" + lines[4][20:-30]
    (tmp_path / "a.log").write_text("\n".join(lines) + '\n{"id":"torn')
    scan = written(log.scanned(spark, str(tmp_path / "a.log")), "scan")
    assert {r.state: r.n for r in scan.groupBy("state").agg(F.count("*").alias("n")).collect()} == {"event": 7, "bad": 1, "torn": 1}
    assert log.quarantine(scan).count() == 2
    assert log.quarantine(scan, log.quarantine(scan)).count() == 0
    events = log.events(scan)
    assert events.select((event_hash() == F.col("hash")).alias("ok")).distinct().collect() == [(True,)]
    gaps = events.filter("gap").select("log", "seq")
    assert [r.seq for r in gaps.collect()] == [6]
    assert chain.verdicts(events, "log", gaps=gaps).first().ok
    assert chain.verdicts(events, "log").first().reason.startswith("seq gap")


def test_tampering_is_found(spark, tmp_path):
    lines = make_log(5)
    lines[2] = lines[2].replace('"value": 3', '"value": 4')
    (tmp_path / "b.log").write_text("\n".join(lines))
    v = chain.verdicts(log.events(written(log.scanned(spark, str(tmp_path / "b.log")), "scan")), "log").first()
    assert (v.ok, v.at) == (False, 3)


def test_number_and_key_rules():
    assert [number_json(x) for x in (1e21, 1.5, 4.0, 1e-7, 0.00001, 123456789012)] == ["1e+21", "1.5", "4", "1e-7", "0.00001", "123456789012"]
    assert canonical_json('{"b":1,"10":2,"9":3,"a":{"d":1,"c":2},"b":5}') == '{"9":3,"10":2,"a":{"c":2,"d":1},"b":5}'
    assert canonical_json("{") is None


def events(spark, rows):
    df = spark.createDataFrame([(s, i, t, json.dumps(p)) for s, i, t, p in rows], "seq long, id string, type string, payload string")
    return written(typed(df), "t")


def test_guard_seal(spark):
    rows = events(spark, [(1, "a", "note", {}), (2, "b", "note", {}), (3, "c", "tombstone.hide", {"hides": "a"})])
    nothing = spark.createDataFrame([], "id string, reason string")
    held = spark.createDataFrame([("b", "law")], "id string, reason string")
    assert tombstone.guard_seal(rows, rows, nothing, 3, 5) == 3
    assert tombstone.guard_seal(rows, rows, nothing, 2, 5) == 0
    assert tombstone.guard_seal(rows.filter("seq < 3"), rows.filter("seq < 3"), held, 3, 3) == 1
    assert [r.target for r in tombstone.hidden_ids(rows).collect()] == ["a"]


def test_revoke_merge_counts(spark):
    s = "hash string, prev string, token_id string, device_id string, epoch long"
    known = spark.createDataFrame([("h1", revoke.ROOT, "t", "d", 1)], s)
    remote = spark.createDataFrame([("h1", revoke.ROOT, "t", "d", 1), ("h3", "h2", "t", "d", 3), ("h2", "h1", "t", "d", 2), ("x", "lost", "t", "d", 9)], s)
    out, counts = revoke.merged(known, remote)
    assert counts == {"added": 2, "skipped": 1, "rejected": 1}
    assert out.count() == 3


def test_live_entries_stream(spark, tmp_path):
    from loomledger.streaming.live_fold import live_entries

    schema = "seq long, id string, type string, payload string"
    rows = [(1, "u", "undo.compensate", {"reverses": "a"}), (2, "a", "entry", {"value": 5}), (3, "b", "entry", {"value": 6}), (4, "r", "entry.failed", {"event_id": "b"})]
    spark.createDataFrame([(s, i, t, json.dumps(p)) for s, i, t, p in rows], schema).write.json(str(tmp_path / "in"))
    q = live_entries(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("live").collect()} == {("a", 5, "RECORDED", 1), ("b", 6, "FAILED", 0)}
