"""Logs written and read back: appends chain, repeated batches change nothing, killed writers leave no trace; fields keep their types."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from loomledger.operators import chain
from loomledger.operators.validate import typed
from loomledger.sources import committed, log
from loomledger.sources.scratch import written

SCHEMA = "id string, seq long, type string, actor string, device_id string, ts_device long, payload string"


def batch(spark, ids, device="d", payload='{"value": 1, "b": {"z": "é\\n", "a": [1.50, null]}}', start=1):
    return spark.createDataFrame([(i, s, "entry", None, device, 1000 + s, payload) for s, i in enumerate(ids, start)], SCHEMA)


def read(spark, path):
    return written(committed.scanned(spark, path), "scan")


def sound(spark, path):
    return {r.log: (r.ok, r.reason) for r in chain.verdicts(log.events(read(spark, path)), "log").collect()}


def test_two_appends_are_one_chain(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert committed.append(batch(spark, "abc"), path) == 1
    assert committed.append(batch(spark, "de").unionByName(batch(spark, "abc", "other")), path) == 2
    assert sound(spark, path) == {"d": (True, None), "other": (True, None)}
    events = log.events(read(spark, path)).orderBy("log", "pos").collect()
    assert [(r.log, r.pos, r.seq, r.id) for r in events] == [("d", k, k + 1, i) for k, i in enumerate("abcde")] + [("other", k, k + 1, i) for k, i in enumerate("abc")]
    # the payload is an object in the line, with its own keys and numbers
    raw = [r.raw for r in read(spark, path).collect()]
    assert all('"payload":{"value": 1, "b": {"z": "é\\n", "a": [1.50, null]}}' in x and "origin_seq" not in x for x in raw)
    assert {r.log: (r.max_seq, r.last_hash) for r in committed.tips(spark, path).collect()} == {"d": (5, events[4].hash), "other": (3, events[7].hash)}
    assert committed.tips(spark, path).count() == log.tips(read(spark, path)).join(committed.tips(spark, path), ["log", "max_seq", "last_hash"]).count()


def test_refusals_write_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    committed.append(batch(spark, "ab"), path)
    for rows, why in (
        (batch(spark, "ca"), "duplicate id a"), (batch(spark, "cc"), "duplicate id c"), (batch(spark, "c", payload="{"), "payload is no JSON"),
        (batch(spark, "c").withColumn("type", F.lit("")), "type must be a non-empty string"), (batch(spark, "c", device=None), "names no log"),
    ):
        with pytest.raises(ValueError, match=why):
            committed.append(rows, path)
    assert committed.append(batch(spark, "ab", "other"), path) == 2  # ids are a log's own
    assert read(spark, path).count() == 4
    assert committed.append(batch(spark, [None, None]), path) == 3
    assert log.events(read(spark, path)).filter("log = 'd'").select("id").distinct().count() == 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert committed.append(batch(spark, "ab"), path, batch="q-0") == 1
    assert committed.append(batch(spark, "cd"), path, batch="q-1") == 2
    assert committed.append(batch(spark, "ab"), path, batch="q-0") == 1
    assert read(spark, path).count() == 4 and committed.commits(spark, path).count() == 2


def test_a_writer_killed_before_its_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    committed.append(batch(spark, "ab"), path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(committed, "create_if_absent", killed)
        committed.append(batch(spark, "xyz"), path)
    assert len(list((tmp_path / "log" / "data").iterdir())) == 2
    assert {r.id for r in log.events(read(spark, path)).collect()} == {"a", "b"}
    assert committed.append(batch(spark, "xc"), path) == 2
    assert sound(spark, path) == {"d": (True, None)}
    assert committed.removed_leftovers(spark, path) == 1
    assert [r.id for r in log.events(read(spark, path)).orderBy("pos").collect()] == ["a", "b", "x", "c"]


def test_two_writers_at_once_make_one_chain(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    failed = []

    def write(ids):
        try:
            committed.append(batch(spark, ids), path)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=([f"{t}{k}" for k in range(5)],)) for t in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sound(spark, path) == {"d": (True, None)}
    assert read(spark, path).count() == 10
    assert not committed.create_if_absent(spark, f"{path}/commits/{1:012d}.json", "late")


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    path, source = f"file://{tmp_path}/log", tmp_path / "in"
    for ids in ("ab", "cd"):
        batch(spark, ids).coalesce(1).write.mode("append").json(str(source))

    def run():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        q = rows.writeStream.foreachBatch(lambda df, n: committed.append(df, path, batch=f"q-{n}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    # the last commit of the stream is forgotten, so its last batch comes again
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    run()
    assert sorted(r.id for r in log.events(read(spark, path)).collect()) == list("abcd") and sound(spark, path) == {"d": (True, None)}


def test_fields_keep_their_types(spark, tmp_path):
    rows = [
        {"id": "a", "seq": 5.0, "type": "entry", "payload": '{"value":5}'}, {"id": "b", "seq": 6, "type": 5, "payload": {"value": 5}}, {"id": 7, "seq": "7", "type": "entry", "payload": {"value": 5}},
        {"id": "c", "seq": 8.5, "type": "entry", "payload": [1]}, {"id": "d", "seq": 9, "type": "entry", "payload": {"value": 5}}, {"id": "e", "seq": 10, "type": "entry", "payload": None}, {"id": "f", "seq": 11, "type": "note", "payload": 12},
    ]
    (tmp_path / "t.log").write_text("\n".join(map(json.dumps, rows)))
    got = log.events(written(log.scanned(spark, str(tmp_path / "t.log")), "s"))
    assert [(r.id, r.seq, r.type) for r in got.orderBy("pos").collect()] == [("a", 5, "entry"), ("b", 6, None), (None, None, "entry"), ("c", None, "entry"), ("d", 9, "entry"), ("e", 10, "entry"), ("f", 11, "note")]
    reasons = [r.poison_reason for r in typed(got).orderBy("pos").collect()]
    assert reasons == ["payload must be an object", "event without type", "event without id", "payload must be an object", None, "payload must be an object", "payload must be an object"]


def test_blank_lines_of_any_white_space_leave_no_gap(spark, tmp_path):
    one = json.dumps({"id": "a", "seq": 1, "type": "note", "payload": {}})
    (tmp_path / "w.log").write_bytes("\r\n".join([one, "", " \t\v", "  ﻿", one.replace("1", "2"), ""]).encode())
    scan = written(log.scanned(spark, str(tmp_path / "w.log")), "s")
    assert [(r.state, r.gap) for r in scan.orderBy("pos").collect()] == [("event", False)] * 2 and log.quarantine(scan).count() == 0
