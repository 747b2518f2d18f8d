"""The registered queries over the driver's tables; every one has SQL in oracles.py, but for the stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.functions import ed25519
from loomledger.functions.canonical import event_hash, quoted
from loomledger.operators import auth, blobs, chain, chunks, retention, revoke, sync, tombstone
from loomledger.operators.fold import Fold, rebuilt_tally
from loomledger.operators.validate import accepted, corrupt, gated, typed
from loomledger.plans.event_view import ledger, table
from loomledger.session import Ledger
from loomledger.sources import committed, log
from loomledger.sources.scratch import shared_folder, written

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    Q[f.__name__] = f
    return f


def _fold(spark: SparkSession, sf_dir: str) -> Fold:
    return Fold(ledger(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a stand-in hash that names its neighbours, for set algebra that only compares hashes."""
    return ledger(spark, sf_dir).withColumn("hash", F.sha2("id", 256))


def _revokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events read as revocations: chains of up to 8 per user group, each link naming the one before it."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("r"), i.cast("string")).alias("hash"),
        F.when(i % 8 < 4, "REVOKE-GENESIS").otherwise(F.concat(F.lit("r"), (i - 3).cast("string"))).alias("prev"),
        F.when(i % 7 == 0, "*").otherwise(F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string"))).alias("token_id"),
        F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device_id"),
        (i % 5).alias("epoch"),
    )


# the fold and its views


@_query
def entries(spark, d):
    return _fold(spark, d).entries()


@_query
def tally(spark, d):
    return _fold(spark, d).tally()


@_query
def tally_one_item(spark, d):
    """All moves are one item's: it is folded in segments of 512 steps."""
    payload = F.regexp_replace("payload", r'"item":"i\d+"', '"item":"x"')
    return Fold(ledger(spark, d).withColumn("payload", payload), segment=512).moves_in_full().select("seq", "event_id", "item", "qty", "underflow", "on_hand", "voided")


@_query
def tally_moves(spark, d):
    return _fold(spark, d).tally_moves()


@_query
def conflicts(spark, d):
    return _fold(spark, d).conflicts()


@_query
def open_conflicts(spark, d):
    return Ledger(ledger(spark, d)).conflicts().groupBy("kind").agg(F.count("*").alias("n"))


@_query
def records(spark, d):
    return _fold(spark, d).records()


@_query
def tally_rebuild(spark, d):
    return rebuilt_tally(_fold(spark, d).tally_moves())


@_query
def actor_balance(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT actor, SUM(value) AS balance FROM entries WHERE voided = 0 GROUP BY actor")


@_query
def live_total(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT COUNT(*) AS n, SUM(value) AS total FROM entries WHERE voided = $v", {"v": 0})


@_query
def voided_ids(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT event_id FROM entries WHERE voided = 1 UNION ALL SELECT event_id FROM tally_moves WHERE voided = 1")


@_query
def distinct_states(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT DISTINCT state FROM entries")


@_query
def negative_moves(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT item, COUNT(*) AS n FROM tally_moves WHERE qty < ? AND voided = ? GROUP BY item", [0, 0])


@_query
def event_entries(spark, d):
    return Ledger(ledger(spark, d)).query("SELECT e.seq, e.id, b.value FROM _events e LEFT JOIN entries b ON b.event_id = e.id WHERE e.type IN ('entry', 'undo.compensate') ORDER BY e.seq")


@_query
def event_point(spark, d):
    return Ledger(ledger(spark, d)).point("e77").select("seq", "id", "type", "actor", "payload")


@_query
def health(spark, d):
    return Ledger(ledger(spark, d)).health().select("events", "skipped", "quarantined", "repaired_tail", F.size("gaps").alias("n_gaps"))


@_query
def max_seq(spark, d):
    return ledger(spark, d).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq"))


@_query
def value_percentiles(spark, d):
    e = _fold(spark, d).entries()
    return e.agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY value)").alias(f"p{p}") for p in (50, 90, 99)])


@_query
def type_counts(spark, d):
    rows = ledger(spark, d)
    return rows.agg(F.count("*").alias("n"), *[F.count_if(F.col("type") == t).alias(t.replace(".", "_")) for t in ("entry", "tally.add", "tally.remove", "undo.compensate")])


@_query
def validation(spark, d):
    """Line items read as payloads, some unfit: fractions, negatives, text, unknown states."""
    li = table(spark, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    value = F.when(k == 0, F.lit('"12"')).when(k == 1, F.lit("-3")).when(k == 2, F.lit("1.5")).when(k == 3, F.lit("true")).when(k == 4, F.lit('"x"')).otherwise(F.col("l_partkey").cast("string"))
    payload = F.concat(F.lit('{"value":'), value, F.when(F.col("l_linenumber") == 7, F.lit(',"state":"FAILED"')).otherwise(F.lit("")), F.lit("}"))
    rows = li.select(F.col("l_orderkey").alias("seq"), F.lit("x").alias("id"), F.lit("entry").alias("type"), payload.alias("payload"))
    out = written(typed(rows), "validation")
    return out.groupBy(F.coalesce("poison_reason", F.lit("fit")).alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("poison_reason").isNull(), F.col("value"))).cast("long").alias("total"))


# logs


@_query
def append_scan(spark, d):
    """Every device's log, appended in two commits, one of them sent twice, read back and verified line by line."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    rows = ledger(spark, d)
    for k in (0, 1, 0):
        committed.append(rows.filter((F.col("seq") % 3 == 0).cast("int") == k), path, batch=f"b{k}")
    events = log.events(written(committed.scanned(spark, path), "scan"))
    return chain.checked(events, "log").select("log", "pos", "seq", "id", "payload", "prev_hash", "hash", "fault")


def _faulty_lines(spark, d):
    """Every device's log as lines: cut, blank, of wrong types, and the last one torn."""
    n = F.col("n")
    rows = ledger(spark, d).withColumns({"n": F.col("seq") % 50, "hash": F.lit(None).cast("string"), "prev_hash": F.lit(None).cast("string")})
    last = rows.groupBy("device_id").agg(F.max("seq").alias("last"))
    rows = rows.join(F.broadcast(last), "device_id")  # a row a device
    seq, kind = F.when(n == 13, F.concat(F.col("seq").cast("string"), F.lit(".0"))).otherwise(F.col("seq").cast("string")), F.when(n == 15, "5").otherwise(quoted(F.col("type")))
    body = F.when(n == 11, quoted(F.col("payload"))).otherwise(F.col("payload"))
    line = F.concat(F.lit('{"id":'), quoted(F.col("id")), F.lit(',"seq":'), seq, F.lit(',"type":'), kind, F.lit(',"payload":'), body, F.lit("}"))
    cut = F.concat(F.lit('{"id":'), quoted(F.col("id")), F.lit(","))
    line = F.when((n == 7) | (F.col("seq") == F.col("last")), cut).when(n == 9, "\r").otherwise(F.concat(line, F.lit("\r")))
    return rows.select("device_id", "seq", line.alias("value"))


@_query
def scan_recovery(spark, d):
    """Lines written from events, with planted faults: the events that are left, with their types and gaps, and what is quarantined."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    _faulty_lines(spark, d).repartition("device_id").sortWithinPartitions("device_id", "seq").select("device_id", "value").write.partitionBy("device_id").text(path)
    scan = written(log.scanned(spark, path), "scan")
    found = typed(log.events(scan)).select(F.lit("event").alias("what"), "seq", "id", "type", "gap", F.col("poison_reason").alias("said"))
    lost = log.quarantine(scan).select(F.lit("quarantined").alias("what"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("gap"), F.col("raw").alias("said"))
    return found.unionByName(lost)


# chains


@_query
def chain_append(spark, d):
    return chain.chained(ledger(spark, d), "actor").select("actor", "seq", "id", "prev_hash", "hash")


@_query
def chain_verify(spark, d):
    """Per-actor logs, some of them tampered with after hashing or shortened by a line."""
    logs = written(chain.chained(ledger(spark, d), "actor"), "chains").withColumn("pos", F.col("seq"))
    n = F.substring("actor", 2, 10).cast("long")
    logs = logs.filter(~((n % 5 == 1) & (F.col("seq") == 3)))
    logs = logs.withColumn("ts_device", F.when((n % 5 == 2) & (F.col("seq") == 2), F.col("ts_device") + 1).otherwise(F.col("ts_device")))
    return chain.verdicts(logs, "actor")


def _chains(spark, d):
    """Per-actor logs with real hashes."""
    return written(chain.chained(ledger(spark, d), "actor"), "chains").withColumn("pos", F.col("seq"))


@_query
def truncate_verify(spark, d):
    """Every actor's log swept to its middle, some tampered with behind the seal, and verified from its marker."""
    logs = _chains(spark, d)
    seals = written(logs.groupBy("actor").agg(F.floor(F.count("*") / 2).alias("sealed")), "seals")
    rest, marks = retention.swept_logs(logs, seals, "actor")
    marks = written(marks, "marks")
    behind = (F.substring("actor", 2, 10).cast("long") % 5 == 2) & (F.col("seq") == F.col("truncated_before"))
    rest = rest.join(marks.select("actor", "truncated_before"), "actor", "left").withColumn("ts_device", F.when(behind, F.col("ts_device") + 1).otherwise(F.col("ts_device"))).drop("truncated_before")
    return chain.verdicts(rest, "actor", markers=marks).join(marks, "actor", "left").select("actor", "ok", "at", "reason", "truncated_before", "tip", "removed")


@_query
def gate_reasons(spark, d):
    """Chained events, some changed after hashing and some excised before, at the gate of the fold."""
    rows = _chains(spark, d)
    rows = rows.withColumn("ts_device", F.when(F.col("seq") % 31 == 0, F.col("ts_device") + 1).otherwise(F.col("ts_device")))
    swept = ledger(spark, d).filter("seq % 50 = 0")
    out = gated(typed(rows), swept)
    return out.filter("poison_reason is not null").select("id", "poison_reason")


# joins and set algebra of replication


@_query
def undo_targets(spark, d):
    rows = written(typed(ledger(spark, d)), "typed")
    undo = rows.filter("type = 'undo.compensate'").select(F.col("id").alias("undo_id"), F.col("seq").alias("undo_seq"), "target")
    return undo.join(rows.select(F.col("id").alias("target"), F.col("type").alias("target_type"), F.col("seq").alias("target_seq")), "target", "left").withColumn("ahead", F.col("undo_seq") < F.col("target_seq"))


@_query
def want_list(spark, d):
    log = _log(spark, d)
    return sync.want(log.select(F.col("seq").alias("pos"), "id"), log.filter("seq % 3 <> 0"))


@_query
def want_merged(spark, d):
    log = _log(spark, d).select(F.col("seq").alias("pos"), "id")
    out = sync.merged_want(log.filter("pos % 5 = 0"), log.filter("pos % 3 = 0"))
    return out.select("place._old", "place.pos", "id").withColumnRenamed("_old", "later")


@_query
def manifest(spark, d):
    return sync.manifest(_log(spark, d))


@_query
def push_ack(spark, d):
    log = _log(spark, d)
    return sync.acknowledged(log, log.filter("seq <= 700 or seq % 2 = 0"), 50)


@_query
def pull_dispositions(spark, d):
    log = ledger(spark, d)
    remote = typed(log.withColumn("payload", F.when(F.col("seq") % 11 == 0, F.lit('{"value":-999}')).otherwise(F.col("payload"))).withColumn("origin_device", F.lit("")))
    remote = remote.unionByName(remote.filter("seq % 10 = 0")).withColumn("pos", F.col("seq"))
    revoked = spark.createDataFrame([("d3",)], "device_id string")
    out = sync.pulled(written(remote, "pulled"), log.filter("seq % 4 = 0"), log.filter("seq % 4 <= 1"), revoked)
    return out.groupBy("disposition").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@_query
def delta_outcomes(spark, d):
    log = ledger(spark, d)
    fetched = written(typed(log.filter("seq % 7 <> 0").withColumn("payload", F.when(F.col("seq") % 11 == 0, F.lit('{"value":-999}')).otherwise(F.col("payload")))), "fetched")
    return sync.delivered(log.filter("seq % 3 = 0"), fetched, log.filter("seq % 13 = 0")).groupBy("outcome").agg(F.count("*").alias("n"))


@_query
def quarantine_device(spark, d):
    f = _fold(spark, d)
    views = {"entries": f.entries(), "tally_moves": written(f.tally_moves(), "moves"), "records": f.records()}
    return sync.quarantined(views, ledger(spark, d).filter("device_id = 'd2'"))["tally"]


@_query
def purge_revoked(spark, d):
    log = ledger(spark, d).withColumn("origin_device", F.when(F.col("seq") % 2 == 0, "d5").otherwise(""))
    _, ids = sync.purge(log, spark.createDataFrame([("d5",)], "device_id string"), log.filter("seq % 9 = 0"), 100)
    return ids


@_query
def quarantine_corrupt(spark, d):
    """Stored rows whose payload is no object any more, as evidence; some are known already."""
    log = ledger(spark, d).withColumn("payload", F.when(F.col("seq") % 97 == 0, '{"value":').when(F.col("seq") % 97 == 1, "[1]").otherwise(F.col("payload")))
    known = log.filter("seq % 970 = 0").select(F.col("id").alias("event_id"), F.lit("before").alias("reason"), F.lit(1).cast("long").alias("ts"), F.lit("{}").alias("event"))
    return sync.evidence(known, log, corrupt(log), 5).select("event_id", "reason", "ts")


@_query
def purge_runs(spark, d):
    """Four purges in a row: all, nothing new, a suffix, and all again since the revoked set has grown."""
    log = ledger(spark, d).withColumn("origin_device", F.lit(""))
    top = log.agg(F.max("seq")).first()[0]
    devices = lambda *x: spark.createDataFrame([(i,) for i in x], "device_id string")
    gone, meta, out = log.limit(0).select("id"), {}, []
    for run, (until, revoked) in enumerate([(top // 2, ("d5",)), (top // 2, ("d5",)), (top, ("d5",)), (top, ("d5", "d1"))]):
        counts, ids, meta = sync.purged(log.filter(F.col("seq") <= until), devices(*revoked), gone, meta)
        out.append((run, counts["scanned"], counts["quarantined"]))
        gone = written(gone.unionByName(ids), "gone")
    return spark.createDataFrame(out, "run int, scanned long, quarantined long")


@_query
def excise(spark, d):
    f = _fold(spark, d)
    log = ledger(spark, d)
    views = {"events": log, "entries": f.entries(), "tally_moves": written(f.tally_moves(), "moves"), "records": f.records()}
    out, _ = retention.excised(views, log.filter("seq % 6 <> 0"), 40)
    return out["tally"]


@_query
def first_unapplied(spark, d):
    log = ledger(spark, d)
    return log.join(log.filter("seq % 500 <> 123").select("seq"), "seq", "left_anti").agg(F.min("seq").alias("seq"))


@_query
def duplicate_ids(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


@_query
def relay_store(spark, d):
    pushed = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), "event_type")
    return sync.stored_by_relay(pushed)


@_query
def relay_page(spark, d):
    relay = ledger(spark, d).select(F.col("seq").alias("pos"), "id", F.concat("id", "type", "payload").alias("json"))
    return sync.page(relay, 100, 500, 6000)


@_query
def relay_pages(spark, d):
    """Every event's page in the feeds of eight relays, one of which holds an event that no page can."""
    rows = ledger(spark, d)
    text = F.when(F.col("id") == "e507", F.repeat(F.lit("x"), 5000)).otherwise(F.concat("id", "payload"))
    return sync.pages(rows.select(F.col("device_id").alias("relay"), F.col("seq").alias("pos"), "id", text.alias("json")), 40, 900)


@_query
def push_chunks(spark, d):
    """Every device's pending events in chunks of ten: some unacknowledged, some acknowledged but unfit."""
    rows = ledger(spark, d)
    acks = rows.filter(~((F.col("seq") % 61 == 0) & F.col("device_id").isin("d0", "d1", "d2", "d3"))).select("id", (F.col("seq") + 1_700_000_000_000).alias("server_time"))
    cursors = rows.filter("device_id in ('d3', 'd4')").select("device_id", F.lit(200).cast("long").alias("since")).distinct()
    out = chunks.pushed(rows, acks, cursors, rows.filter("seq % 50 = 3"))
    return out.select("device_id", "seq", "id", "chunk", "sent", "server_time", "outcome")


@_query
def push_totals(spark, d):
    """What each device's push comes to."""
    rows = ledger(spark, d)
    acks = rows.filter("seq % 97 <> 0").select("id", F.lit(1).cast("long").alias("server_time"))
    cursors = rows.select("device_id", F.lit(30).cast("long").alias("since")).distinct()
    return chunks.push_summary(chunks.pushed(rows, acks, cursors, rows.filter("seq % 50 = 3")), cursors)


@_query
def delta_chunks(spark, d):
    """Two delta runs per device, the second from what the first has committed: ids not delivered, unfit, not stored, or wanted twice."""
    rows = ledger(spark, d).select("device_id", F.col("seq").alias("place"), "id")
    manifest = rows.unionByName(rows.filter("place % 40 = 1").withColumn("place", F.col("place") + 1_000_000_000))
    served = rows.filter("place % 31 <> 0").select("device_id", "id", F.when(F.col("place") % 23 == 0, "unfit").alias("poison_reason"), (F.col("place") % 101 != 0).alias("stored"))
    state = chunks.State(spark, f"{shared_folder(spark)}/delta-{uuid.uuid4().hex}")
    local = written(rows.filter("place % 3 = 0").select("device_id", "id"), "local")
    out = []
    for run in (1, 2):
        outcomes, _ = chunks.delta_round(state, manifest, local, served, size=10)
        outcomes = written(outcomes.select(F.lit(run).alias("run"), "device_id", "id", "outcome"), "outcomes")
        local = local.unionByName(outcomes.filter("outcome = 'applied'").select("device_id", "id"))
        served = served.withColumn("stored", F.lit(True))  # storing works from here on
        out.append(outcomes)
    return out[0].unionByName(out[1])


@_query
def push_budget(spark, d):
    return sync.over_budget(ledger(spark, d).select(F.col("payload").alias("json")), 500, 16)


@_query
def device_registry(spark, d):
    devices = spark.createDataFrame([(f"d{i}", i % 2 == 0) for i in range(6)], "device_id string, trusted boolean")  # six rows
    rows = ledger(spark, d).join(F.broadcast(devices), "device_id", "left")
    word = F.when(F.col("trusted").isNull(), "unknown").when(F.col("trusted"), "accept").otherwise("reject")
    return rows.groupBy(word.alias("verdict")).agg(F.count("*").alias("n"))


def _replicas(spark, d):
    """Three relays, each without a quarter of the events, in their own order."""
    e = ledger(spark, d).select("id", "seq", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("relay"))
    return e.filter((F.col("seq") + F.col("relay")) % 4 != 0).withColumn("pos", F.col("seq"))


@_query
def failover_pull(spark, d):
    cursors = spark.createDataFrame([(0, 300), (1, 50)], "relay int, since long")
    return sync.pulled_from_all(_replicas(spark, d), cursors)[0].select("id", "relay", "pos")


@_query
def failover_cursors(spark, d):
    cursors = spark.createDataFrame([(0, 300), (1, 1 << 40)], "relay int, since long")
    return sync.pulled_from_all(_replicas(spark, d), cursors)[1]


@_query
def failover_backfill(spark, d):
    """The relay is given half of the log as acknowledged."""
    log = _log(spark, d)
    return sync.backfill(log, _replicas(spark, d).filter("relay = 1"), log.agg(F.max("seq")).first()[0] // 2).select("seq", "id")


@_query
def replay_dispositions(spark, d):
    """Runs of three events share an id; errors are unfit."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), (F.col("event_id") - F.col("event_id") % 3).cast("string")).alias("id"), F.when(F.col("event_type") == "error", "unfit").alias("poison_reason"))
    return accepted(rows).select("seq", "id", "disposition")


# authorization: every event asks, with its device's token or its user group's grant, at the time of its id


def _signed(private: list[str], kind: str, rows: DataFrame) -> DataFrame:
    """A handful of fixed tokens or grants (rows: column t, and `broken`), signed on the driver; broken ones over other bytes."""
    text = (auth.token_text if kind == "token" else auth.grant_text)(F.col("t"))
    out = [(r.key, ed25519.sign(private[r.key % len(private)], r.text + "x" * r.broken)) for r in rows.select("key", "broken", text.alias("text")).collect()]
    signatures = rows.sparkSession.createDataFrame(out, "key long, signature string")
    return rows.join(F.broadcast(signatures), "key").withColumn("t", F.col("t").withField("signature", F.col("signature"))).select("key", "t")


def _keys(n: int) -> list[tuple[str, str]]:
    return [ed25519.key_pair(bytes([i]) * 32) for i in range(1, n + 1)]


@_query
def authorize_tokens(spark, d):
    keys = _keys(8)
    both = ["relay:push", "relay:pull"]
    rows = [(i, ("t%d" % i, "d%d" % i, both[:1] if i == 4 else both, 0, 500 if i == 3 else 1 << 40, 1000 if i == 6 else None, None), int(i == 5)) for i in range(8)]
    tokens = _signed([k[1] for k in keys], "token", spark.createDataFrame(rows, f"key long, t {auth.TOKEN}, broken int"))
    registry = spark.createDataFrame([(f"d{i}", keys[i][0]) for i in range(8) if i != 1], "device_id string, pem string")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id") % 8).alias("key"))
    asks = e.join(F.broadcast(tokens), "key", "left").select("event_id", F.col("t").alias("token"), F.when(F.col("event_id") % 2 == 0, both[0]).otherwise(both[1]).alias("scope"), F.col("event_id").alias("now"))
    gone = lambda x: spark.createDataFrame([(x,)], "id string")
    return auth.authorized(asks, registry, gone("d0"), gone("t2")).select("event_id", "refused")


@_query
def authorize_grants(spark, d):
    (public, private), = _keys(1)
    both = ["entries:append", "entries:resolve"]
    rows = [(i, ("g%d" % i, "d", both[:1] if i == 2 else both, "office", 100 if i == 1 else 0, 600 if i == 1 else 1 << 40, None), int(i == 3)) for i in range(5)]
    grants = _signed([private], "grant", spark.createDataFrame(rows, f"key long, t {auth.GRANT}, broken int"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id") % 5).alias("key"))
    asks = e.join(F.broadcast(grants), "key", "left").select("event_id", F.col("t").alias("grant"), F.when(F.col("event_id") % 2 == 0, both[0]).otherwise(both[1]).alias("scope"), F.col("event_id").alias("now"))
    return auth.granted(asks, public, spark.createDataFrame([("g0",)], "id string")).select("event_id", "refused")


def _signed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events, registry): an entry per supplier, signed by one of four devices of which three are registered.

    Every seventh is changed after it was hashed, some signatures are of other bytes, null or empty, and the
    countersigners go by the key's remainder of 5: none, one, two, one twice, one and an unregistered device.
    """
    keys = _keys(4)
    k = F.col("s_suppkey")
    device = lambda i: F.concat(F.lit("d"), i.cast("string"))
    private = lambda i: F.get(F.array(*[F.lit(x[1]) for x in keys]), i.cast("int"))
    rows = auth.spread(table(spark, sf_dir, "supplier")).select(
        "s_suppkey",
        F.concat(F.lit("s"), k.cast("string")).alias("id"),
        k.cast("long").alias("seq"),
        F.lit("entry").alias("type"),
        F.lit("office").alias("actor"),
        device(k % 4).alias("device_id"),
        k.cast("long").alias("ts_device"),
        F.when(k % 3 == 0, '{"value":100}').otherwise('{"value":5}').alias("payload"),
        F.lit("GENESIS").alias("prev_hash"),
    )
    rows = rows.withColumn("hash", event_hash())
    own = ed25519.signed(private(k % 4), F.when(k % 13 > 1, F.when(k % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))))
    pairs = {1: (0, None), 2: (0, 1), 3: (1, 1), 4: (0, 3)}  # devices that countersign, by the key's remainder
    of = lambda place: F.coalesce(*[F.when(k % 5 == r, F.lit(p[place]).cast("int")) for r, p in pairs.items()])
    votes = [(of(place), ed25519.signed(private(of(place)), F.when(of(place).isNotNull(), F.col("hash")))) for place in (0, 1)]
    counter = F.filter(F.array(*[F.struct(device(i).alias("deviceId"), s.alias("signatureHex")) for i, s in votes]), lambda c: c["deviceId"].isNotNull())
    events = rows.select(
        *[c for c in rows.columns if c not in ("s_suppkey", "payload")],
        F.when(k % 7 == 0, '{"value":9}').otherwise(F.col("payload")).alias("payload"),
        F.when(k % 13 == 1, "").otherwise(own).alias("signature"),
        counter.alias("countersignatures"),
    )
    return written(events, "signed_events"), spark.createDataFrame([(f"d{i}", keys[i][0]) for i in range(3)], "device_id string, pem string")


@_query
def event_gate(spark, d):
    """Which pulled events are authentic, entries of 50 or more only with two countersignatures."""
    events, registry = _signed_events(spark, d)
    return auth.authentic(events, registry, limit=50, threshold=2).select("id", "authentic")


@_query
def countersignatures(spark, d):
    events, registry = _signed_events(spark, d)
    return auth.countersigned(events, registry, 2)


# tombstones and retention


@_query
def tombstones(spark, d):
    return tombstone.operations(written(typed(ledger(spark, d)), "typed"))


@_query
def hidden_ids(spark, d):
    return tombstone.hidden_ids(written(typed(ledger(spark, d)), "typed"))


@_query
def tombstone_targets(spark, d):
    return tombstone.pairs(written(typed(ledger(spark, d)), "typed"))


@_query
def seal_islands(spark, d):
    return tombstone.islands(tombstone.pairs(written(typed(ledger(spark, d)), "typed")))


@_query
def guard_pairs(spark, d):
    """What forces a seal down that two holds bound: the pairs it would part one after the other, and where it ends."""
    rows = written(typed(ledger(spark, d)), "typed")
    top = rows.agg(F.max("seq")).first()[0]
    held = spark.createDataFrame([(f"e{top // 2}", "law"), (f"e{top // 2 + 7}", "law"), ("unknown", "law")], "id string, reason string")
    effective, _, parted = tombstone.guard(rows, rows, held, top, top - 5)
    return spark.createDataFrame([(t, o, effective) for t, o in parted] or [(None, None, effective)], "target_seq long, op_seq long, effective long")


@_query
def hide_plans(spark, d):
    """Requests to hide and show, some of unknown, hidden or shown events."""
    rows = written(typed(ledger(spark, d)), "typed")
    asks = table(spark, d, "customer").select(F.concat(F.lit("e"), (F.col("c_custkey") * 10).cast("string")).alias("id"), F.when(F.col("c_custkey") % 3 == 0, "show").otherwise("hide").alias("op"))
    return tombstone.planned(asks, rows)


@_query
def held_events(spark, d):
    held = table(spark, d, "customer").select(F.concat(F.lit("e"), (F.col("c_custkey") * 7).cast("string")).alias("id"), F.col("c_mktsegment").alias("reason"))
    return tombstone.holds(held, ledger(spark, d))


@_query
def sweep(spark, d):
    log = _log(spark, d)
    rest, marker = retention.swept(log, 300)
    return rest.agg(F.count("*").alias("kept"), F.min("seq").alias("first")).withColumns({"tip": F.lit(marker["tip"]), "truncated_before": F.lit(marker["truncated_before"]).cast("long"), "next_seq": F.lit(marker["next_seq"]).cast("long")})


# revocations


@_query
def revoke_winners(spark, d):
    return revoke.winners(_revokes(spark, d))


@_query
def revoke_dangling(spark, d):
    return revoke.dangling(_revokes(spark, d)).select("hash", "prev")


@_query
def revoke_merge(spark, d):
    rows = _revokes(spark, d)
    return revoke.merged(rows.filter("epoch = 0 and prev = 'REVOKE-GENESIS'"), rows)[0].select("hash", "prev")


@_query
def revoke_since(spark, d):
    """The suffix of a revocation log behind a cursor, in order of arrival."""
    rows = _revokes(spark, d).withColumn("pos", F.substring("hash", 2, 20).cast("long"))
    return revoke.since(rows, 100)[0].select("hash", "pos")


@_query
def revoke_verify(spark, d):
    """A signed revocation per supplier, with faults by the key's remainders: why each is refused, or null."""
    keys, k = _keys(3), F.col("s_suppkey")
    core = auth.spread(table(spark, d, "supplier")).select(
        F.when(k % 17 == 0, revoke.VERSION + 1).otherwise(revoke.VERSION).alias("v"),
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("tokenId"),
        F.concat(F.lit("d"), (k % 8).cast("string")).alias("deviceId"),
        F.when(k % 23 == 0, -1).otherwise(k % 5).cast("long").alias("epoch"),
        F.concat(F.lit("a"), (k % 3).cast("string")).alias("admin"),
        k.cast("long").alias("issuedAt"),
        F.lit(revoke.ROOT).alias("prev"),
    )
    at = F.col("issuedAt")  # the supplier's key
    rows = core.withColumn("hash", F.sha2(F.to_json(F.struct(*core.columns)), 256))
    private = F.get(F.array(*[F.lit(x[1]) for x in keys]), (at % 3).cast("int"))
    rows = rows.withColumn("sig", ed25519.signed(private, F.when(at % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))))
    rows = rows.withColumn("id", F.when(at % 13 == 0, "x").otherwise(F.col("hash"))).withColumn("deviceId", F.when(at % 7 == 0, "other").otherwise(F.col("deviceId")))
    admins = spark.createDataFrame([(f"a{i}", keys[i][0]) for i in range(2)], "admin string, pem string")
    return revoke.verified(rows, admins).select(at.alias("s_suppkey"), "rejected")


@_query
def revoked_devices(spark, d):
    return revoke.revoked_devices(_revokes(spark, d))


@_query
def revoked_tokens(spark, d):
    tokens = table(spark, d, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 60).cast("string")).alias("token_id"), (F.col("c_custkey") % 6).alias("epoch"), "c_custkey")
    return revoke.is_revoked(tokens, _revokes(spark, d))


# blobs and quotas


@_query
def blob_references(spark, d):
    return blobs.references(table(spark, d, "documents"), "text").withColumn("path", blobs.path_of(F.col("key")))


@_query
def blob_garbage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", blobs.key(F.coalesce("text", F.lit(""))).alias("key"))
    refs = docs.filter("doc_id % 3 <> 0").groupBy("key").agg(F.count("*").alias("refs"))
    return blobs.collect_garbage(docs.filter("doc_id % 5 <> 0"), refs, docs.filter("doc_id % 33 = 0"))


@_query
def blob_store(spark, d):
    """Texts put into a store, each row a reference; some linked once more, some unlinked, and what is left of them."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    none = docs.limit(0)
    store, refs = blobs.put(none.select(blobs.key(F.col("content")).alias("key"), "content"), none.select(blobs.key(F.col("content")).alias("key"), F.lit(0).cast("long").alias("refs")), docs.select("content"))
    store, refs = written(store, "blobs"), written(refs, "refs")
    change = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, -1).cast("long")
    changes = docs.select(blobs.key(F.col("content")).alias("key"), change.alias("refs")).filter("refs is not null")
    refs, _ = blobs.linked(refs, changes)
    return blobs.stats(store, refs)


@_query
def quota(spark, d):
    return blobs.quota(ledger(spark, d), 1_000_000, 512)


# relational queries that the SQL surface takes


def _sql(name: str, tables: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    Q[name] = run
    SAME_SQL[name] = text


#: Queries whose text both engines take as it is.
SAME_SQL: dict[str, str] = {}
_sql("sql_pricing", "lineitem", """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS qty, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
_sql("sql_nation_orders", "orders customer nation region", """SELECT r_name, n_name, COUNT(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""")
_sql("sql_semi", "orders lineitem", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
_sql("sql_anti", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
_sql("sql_in_like", "part", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_size IN (1, 5, 9, 14) AND p_type LIKE 'S%'")
_sql("sql_top_customers", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_sql("sql_top_per_nation", "supplier", "SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) t WHERE k <= 2")
_sql("sql_set_ops", "orders customer", "SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10 INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
_sql("sql_cube", "orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_running", "events", "SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM events")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of every actor's live entries, and how many of the actor's transitions and removes are in conflict."""
    f = _fold(spark, sf_dir)
    balance = f.entries().filter("voided = 0").groupBy("actor").agg(F.sum("value").alias("balance"), F.count("*").alias("entries"))
    hit = f.conflicts().select(F.element_at(F.from_json("event_ids", "array<string>"), -1).alias("id"))
    count = hit.join(f.events.select("id", "actor"), "id").groupBy("actor").agg(F.count("*").alias("conflicts"))
    return balance.join(count, "actor", "left").select("actor", "balance", "entries", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


Q["balances_with_conflicts"] = flagship
