"""Replication as set algebra: want-lists, acknowledgements, pull dispositions, quarantine and relay pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomledger.operators.fold import rebuilt_tally
from loomledger.operators.neighbours import reachable, running
from loomledger.sources.scratch import written


def want(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """(pos, id): manifest ids that are not stored here; empty ids drop out, repeated ones stay."""
    return manifest.filter("id is not null and id <> ''").join(local.select("id"), "id", "left_anti").select("pos", "id")


def merged_want(persisted: DataFrame, fresh: DataFrame) -> DataFrame:
    """(pos, id): wanted before and still wanted first, then the rest, each in manifest order."""
    old = persisted.select("id").distinct().withColumn("_old", F.lit(0))
    rows = fresh.join(old, "id", "left").select("id", "pos", F.coalesce("_old", F.lit(1)).alias("_old"))
    return rows.select(F.struct("_old", "pos").alias("place"), "id")


def manifest(log: DataFrame) -> DataFrame:
    """One row: events, the last one's hash, and the highest seq; the ids are the log's own id column in seq order."""
    return log.agg(F.count("*").alias("count"), F.max_by("hash", "seq").alias("tip"), F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def acknowledged(pending: DataFrame, acked: DataFrame, cursor: int) -> DataFrame:
    """(advanced, acked): how far the leading run of acknowledged events reaches, in seq order."""
    rows = pending.filter(F.col("seq") > cursor).join(acked.select("id").distinct().withColumn("_ok", F.lit(True)), "id", "left")
    stop = rows.filter("_ok is null").agg(F.min("seq").alias("stop"))
    run = rows.filter("_ok").crossJoin(F.broadcast(stop)).filter("stop is null or seq < stop")  # stop is one row
    return run.agg(F.coalesce(F.max("seq"), F.lit(cursor)).alias("advanced"), F.count("*").alias("acked"))


def origin(device: str = "device_id", first: str = "origin_device") -> Column:
    return F.coalesce(F.nullif(F.col(first), F.lit("")), F.col(device))


def pulled(remote: DataFrame, stored: DataFrame, logged: DataFrame, revoked: DataFrame) -> DataFrame:
    """remote (typed, with pos) plus `disposition`, by the first gate that holds:

    skip_id, purge (stored, since revoked), stored, quarantine_parked, redrive
    (logged, not stored), skip_shape, quarantine, duplicate (again in the batch), applied.
    """
    mark = lambda df, key, name: df.select(F.col(key).alias(f"_{name}")).distinct()
    rows = remote.withColumn("_origin", origin())
    for df, key, on, name in ((stored, "id", "id", "stored"), (logged, "id", "id", "logged"), (revoked, "device_id", "_origin", "revoked")):
        m = mark(df, key, name)
        rows = rows.join(m, rows[on] == m[f"_{name}"], "left")
    is_stored, is_logged, is_revoked = (F.col(f"_{n}").isNotNull() for n in ("stored", "logged", "revoked"))
    word = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "skip_id")
        .when(is_stored & is_revoked, "purge")
        .when(is_stored, "stored")
        .when(is_logged & is_revoked, "quarantine_parked")
        .when(is_logged, "redrive")
        .when(F.col("poison_reason").isNotNull(), "skip_shape")
        .when(is_revoked, "quarantine")
        .otherwise("applied")
    )
    rows = rows.withColumn("disposition", word)
    # only what would be applied can be a repetition; every other row is a group of its own, so that rows without an id share none
    applied = F.col("disposition") == "applied"
    rows = rows.withColumn("_group", F.when(applied, F.concat(F.lit("i"), "id")).otherwise(F.monotonically_increasing_id().cast("string")))
    again = F.row_number().over(Window.partitionBy("_group").orderBy("pos")) > 1
    return rows.withColumn("disposition", F.when(applied & again, "duplicate").otherwise(F.col("disposition"))).drop("_origin", "_stored", "_logged", "_revoked", "_group")


def delivered(wanted: DataFrame, fetched: DataFrame, dead: DataFrame) -> DataFrame:
    """(id, outcome) of one delta round: applied, poison, retry (not delivered) or dead (given up before)."""
    rows = wanted.select("id").distinct().join(dead.select("id").distinct().withColumn("_dead", F.lit(True)), "id", "left")
    got = fetched.groupBy("id").agg(F.min(F.when(F.col("poison_reason").isNull(), 0).otherwise(1)).alias("_bad"))
    rows = rows.join(got, "id", "left")
    return rows.select("id", F.when(F.col("_dead"), "dead").when(F.col("_bad").isNull(), "retry").when(F.col("_bad") == 1, "poison").otherwise("applied").alias("outcome"))


def quarantined(views: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Views without what the quarantined events put there; events stay, the tally is summed anew."""
    ids = ids.select(F.col("id").alias("event_id"))
    out = {name: views[name].join(ids, "event_id", "left_anti") for name in ("entries", "tally_moves", "records")}
    return views | out | {"tally": rebuilt_tally(out["tally_moves"])}


def purge(log: DataFrame, revoked: DataFrame, already: DataFrame, cursor: int) -> tuple[dict, DataFrame]:
    """({scanned, quarantined}, ids) over the log after the cursor; the cursor is 0 whenever the revoked set has changed."""
    new = log.filter(F.col("seq") > cursor)
    devices = revoked.select(F.col("device_id").alias("_origin")).distinct()
    ids = new.withColumn("_origin", origin()).join(devices, "_origin", "left_semi").select("id").join(already.select("id"), "id", "left_anti")
    return {"scanned": new.count(), "quarantined": ids.count()}, ids


def evidence(known: DataFrame, events: DataFrame, reasons: DataFrame, now: int) -> DataFrame:
    """The quarantine (event_id, reason, ts, event as JSON) with the events that reasons (event_id, reason) name; what is known stays as it is."""
    new = reasons.groupBy("event_id").agg(F.min("reason").alias("reason")).join(known.select("event_id"), "event_id", "left_anti")
    body = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    rows = events.withColumn("_event", body).select(F.col("id").alias("event_id"), F.col("_event").alias("event")).dropDuplicates(["event_id"])
    return known.unionByName(new.join(rows, "event_id", "left").select("event_id", "reason", F.lit(now).cast("long").alias("ts"), F.coalesce("event", "event_id").alias("event")))


def listed_evidence(quarantine: DataFrame) -> DataFrame:
    """The quarantine, oldest first."""
    return quarantine.select("event_id", "reason", "ts", "event").orderBy("ts", "event_id")


def is_quarantined(quarantine: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with `quarantined`."""
    known = quarantine.select(F.col("event_id").alias("id")).distinct().withColumn("_known", F.lit(True))
    return ids.join(known, "id", "left").select("id", F.coalesce("_known", F.lit(False)).alias("quarantined"))


def fingerprint(revoked: DataFrame, version: int | str | None = None) -> str:
    """One text for a set of revoked devices (a digest that does not depend on their order) and the version of what else revokes."""
    row = revoked.select("device_id").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("device_id").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return f"{row['n']}:{row['h']}|{'' if version is None else version}"


def purged(log: DataFrame, revoked: DataFrame, already: DataFrame, meta: dict[str, str], version: int | str | None = None) -> tuple[dict, DataFrame, dict[str, str]]:
    """purge() behind the cursor kept in meta, or from the start if what is revoked has changed: (counts, ids, new meta)."""
    print_ = fingerprint(revoked, version)
    since = int(meta.get("sync.purge_seq", 0)) if meta.get("sync.purge_revoke_fp") == print_ else 0
    counts, ids = purge(log, revoked, already, since)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
    return counts, ids, meta | {"sync.purge_seq": str(max(since, top)), "sync.purge_revoke_fp": print_}


def relay_order(not_before: list[int], now: int) -> list[int]:
    """Relays in list order, those still cooling down last."""
    return sorted(range(len(not_before)), key=lambda i: now < not_before[i])


def pulled_from_all(feeds: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, cursors) over the logs of all relays (relay, pos, id, ...): each id behind its relay's cursor once, from the
    first relay in order that has it, and how far every relay has been read. A relay without a cursor is read from its start.
    """
    seen = cursors.groupBy("relay").agg(F.max("since").alias("_since"))
    new = feeds.join(seen, "relay", "left").filter(F.col("pos") > F.coalesce("_since", F.lit(0))).drop("_since")
    columns = [c for c in new.columns if c != "id"]
    events = new.filter("id is not null and id <> ''").groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("relay", "pos")).alias("e")).select("id", "e.*")
    moved = new.groupBy("relay").agg(F.max("pos").alias("since")).unionByName(cursors.select("relay", "since"))
    return events, moved.groupBy("relay").agg(F.max("since").alias("since"))


def backfill(log: DataFrame, relay: DataFrame, acked: int) -> DataFrame:
    """What a relay newly switched to lacks of the acknowledged prefix."""
    return log.filter(F.col("seq") <= acked).join(relay.select("id"), "id", "left_anti")


def outbox_full(top_seq: int, ack_seq: int, cap: int = 50_000) -> bool:
    """Whether appending must wait for acknowledgements."""
    return top_seq - ack_seq >= cap


def stored_by_relay(pushed: DataFrame) -> DataFrame:
    """First arrival of every id, by pos."""
    columns = [c for c in pushed.columns if c != "id"]
    return pushed.groupBy("id").agg(F.min_by(F.struct(*columns), "pos").alias("e")).select("id", "e.*")


def page(relay: DataFrame, since: int, max_events: int, max_bytes: int) -> DataFrame:
    """The events after `since` that one answer holds: at most max_events, and bytes up to max_bytes in running sum."""
    head = relay.filter(F.col("pos") > since).orderBy("pos").limit(max_events)  # the page size is the feature
    total = F.sum(F.octet_length("json")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return head.withColumn("bytes_so_far", total).filter(F.col("bytes_so_far") <= max_bytes)


def pages(feed: DataFrame, max_events: int, max_bytes: int, log: str = "relay") -> DataFrame:
    """Every event of whole feeds (log, pos, id, json) with the page it comes in, from 1; `too_large` for one that no page can hold: there its feed ends, and what lies behind has no page.

    Where a page that begins at an event would end follows from running sums of bytes, found by one sort of ends among
    sums. The beginnings that a reader meets are those that pointers reach from the first: found by doubling, in as many
    passes as the number of pages has binary digits.
    """
    size = F.octet_length("json")
    rows = written(running(feed.select(log, "pos", "id", size.cast("long").alias("bytes")), log, "pos", place=F.lit(1), upto=F.col("bytes")), "pages")
    # how many events fit below a page's last byte: among all running sums, the rank of the sum before plus the budget
    ends = rows.select(log, (F.col("upto") - F.col("bytes") + max_bytes).alias("at"), F.lit(0).alias("one"), F.lit("~").alias("id"), "place")
    sums = rows.select(log, F.col("upto").alias("at"), F.lit(1).alias("one"), F.lit("").alias("id"), "place")  # sums come before an end of equal value
    fit = running(ends.unionByName(sums), log, "at", fit=F.col("one")).filter("one = 0").select(log, "place", "fit")
    after = F.least(F.col("fit") + 1, F.col("place") + max_events)
    last = rows.groupBy(log).agg(F.max("place").alias("last"))
    jump = fit.withColumn("next", after).filter("next > place").join(last, log).filter("next <= last").select(log, F.col("place").alias("a"), F.col("next").alias("b"))
    begins = reachable(rows.filter("place = 1"), jump, log)
    rows = rows.join(begins.withColumn("_first", F.lit(1)), [log, "place"], "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    stop = rows.filter((F.col("_first") == 1) & (F.col("bytes") > max_bytes)).groupBy(log).agg(F.min("place").alias("_stop"))
    rows = running(rows, log, "place", page=F.col("_first")).join(stop, log, "left")
    inside = F.coalesce(F.col("place") < F.col("_stop"), F.lit(True))
    return rows.select(log, "pos", "id", F.when(inside, F.col("page")).alias("page"), F.coalesce(F.col("place") == F.col("_stop"), F.lit(False)).alias("too_large"))


def over_budget(events: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """One row: events, those above the byte budget, and whether the batch is refused."""
    out = events.agg(F.count("*").alias("events"), F.count_if(F.octet_length("json") > max_bytes).alias("too_large"))
    return out.withColumn("refused", (F.col("events") > max_events) | (F.col("too_large") > 0))


def backoff_ms(attempt: int, base: int = 500, most: int = 30_000) -> int:
    """Doubling delay with the default jitter."""
    return min(most, base * 2**attempt) + ((attempt + 1) * 37) % 100
