"""Revocation logs: authentic events, convergent merge, winners per token, and who is revoked."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomledger.functions import ed25519
from loomledger.functions.canonical import quoted
from loomledger.operators.auth import listed, spread
from loomledger.sources.scratch import written

ROOT = "REVOKE-GENESIS"
VERSION = 1
#: One signed event as it is exchanged; the hash covers the fields before it, in this order.
SIGNED = "v int, tokenId string, deviceId string, epoch long, admin string, issuedAt long, prev string, hash string, sig string, id string"
_COLUMNS = ["hash", "prev", "token_id", "device_id", "epoch"]


def signed(private_pem: str, admin: str, token_id: str, device_id: str, epoch: int, issued_at: int, prev: str = ROOT) -> dict:
    """One event of an admin, signed."""
    if not (token_id and device_id and admin and prev) or epoch < 0:
        raise ValueError("a revocation needs a token, a device, an admin, a prev and an epoch from 0")
    core = {"v": VERSION, "tokenId": token_id, "deviceId": device_id, "epoch": epoch, "admin": admin, "issuedAt": issued_at, "prev": prev}
    digest = hashlib.sha256(json.dumps(core, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return core | {"hash": digest, "sig": ed25519.sign(private_pem, digest), "id": digest}


def verified(events: DataFrame, admins: DataFrame) -> DataFrame:
    """events (SIGNED) plus `rejected`, the first reason or null; admins: admin, pem."""
    c, text = F.col, {"tokenId", "deviceId", "admin", "prev"}
    core = [n.split()[0] for n in SIGNED.split(", ")[:7]]
    parts = [F.concat(F.lit(f'"{n}":'), quoted(c(n)) if n in text else c(n).cast("string")) for n in core]
    rows = listed(spread(events), admins.select(c("admin").alias("_admin"), c("pem").alias("_pem")), c("admin"), "_known", "_pem")
    empty = lambda n: F.coalesce(c(n) == "", F.lit(True))
    cheap = (
        F.when(~c("v").eqNullSafe(F.lit(VERSION)), F.concat(F.lit("unsupported v "), F.coalesce(c("v").cast("string"), F.lit("null"))))
        .when(empty("tokenId"), "empty tokenId").when(empty("deviceId"), "empty deviceId").when(empty("admin"), "empty admin")
        .when(F.coalesce(c("epoch") < 0, F.lit(True)), F.concat(F.lit("bad epoch "), F.coalesce(c("epoch").cast("string"), F.lit("null"))))
        .when(c("issuedAt").isNull(), "bad issuedAt").when(empty("prev"), "empty prev")
        .when(~c("id").eqNullSafe(c("hash")), "id/hash split")
        .when(~c("hash").eqNullSafe(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)), "hash mismatch (tampered payload?)")
        .when(~c("_known"), F.concat(F.lit("unknown admin "), c("admin")))
    )
    rows = rows.withColumn("_cheap", cheap)
    rows = rows.withColumn("_signed", ed25519.holds(c("_pem"), c("hash"), c("sig"), c("_cheap").isNull()))
    return rows.select(*events.columns, F.when(c("_cheap").isNotNull(), c("_cheap")).when(~c("_signed"), "bad admin signature").alias("rejected"))


def merged(known: DataFrame, remote: DataFrame, name: str = "revokes") -> tuple[DataFrame, dict[str, int]]:
    """known plus what of remote hangs, through any number of prevs, on it or on the root; and {added, skipped, rejected}.

    Every pass doubles how far back each event looks (its prev's prev, and so on), so that a chain of n takes log n passes.
    A hash that stands twice in remote counts once as added, then as skipped.
    """
    total = remote.count()
    new = written(remote.select(*_COLUMNS).dropDuplicates(["hash"]).join(known.select("hash"), "hash", "left_anti"), name)
    sure = known.select("hash").unionByName(known.sparkSession.createDataFrame([(ROOT,)], "hash string")).distinct()
    # `up`: the furthest ancestor seen so far; null once it is known to be the root's or known's
    now = written(new.select("hash", "prev").join(sure.select(F.col("hash").alias("prev"), F.lit(True).alias("_sure")), "prev", "left").select("hash", F.when(F.col("_sure").isNull(), F.col("prev")).alias("up")), name)
    open_ = now.filter("up is not null").count()
    for _ in range(open_.bit_length() + 1):  # what still looks up after so many passes goes round in a circle
        above = now.select(F.col("hash").alias("up"), F.col("up").alias("_next"))
        step = written(now.filter("up is not null").join(above, "up").select("hash", F.col("_next").alias("up")).unionByName(now.filter("up is null")), name)
        now = step
        if now.filter("up is not null").isEmpty():
            break
    reached = now.filter("up is null").select("hash")
    out = written(known.select(*_COLUMNS).unionByName(new.join(reached, "hash", "left_semi").select(*_COLUMNS)), name)
    added = out.count() - known.count()
    return out, {"added": added, "skipped": total - added - (new.count() - added), "rejected": new.count() - added}


def dangling(events: DataFrame) -> DataFrame:
    """Events whose prev is neither the root nor any event's hash."""
    return events.filter(F.col("prev") != ROOT).join(events.select(F.col("hash").alias("prev")), "prev", "left_anti")


def winners(events: DataFrame) -> DataFrame:
    """Per token the highest epoch, of equals the least hash."""
    first = Window.partitionBy("token_id").orderBy(F.desc("epoch"), "hash")
    return events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def revoked_devices(events: DataFrame) -> DataFrame:
    return events.filter("token_id = '*'").select("device_id").distinct()


def is_revoked(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """tokens (token_id, epoch) plus `revoked`: an event of the token has its epoch or a later one."""
    top = events.groupBy("token_id").agg(F.max("epoch").alias("_top"))
    return tokens.join(top, "token_id", "left").withColumn("revoked", F.coalesce(F.col("_top") >= F.col("epoch"), F.lit(False))).drop("_top")


def snapshot(events: DataFrame) -> DataFrame:
    """All events by epoch, then hash: what another replica merges."""
    return events.orderBy("epoch", "hash")


def since(events: DataFrame, cursor: int) -> tuple[DataFrame, int]:
    """(events in order of arrival (column pos, from 0) behind the cursor, new cursor). A cursor beyond the log is an error."""
    size = events.count()
    if isinstance(cursor, bool) or not isinstance(cursor, int) or not 0 <= cursor <= size:
        raise ValueError(f"revoke rejected: bad cursor {cursor}")
    return events.filter(F.col("pos") >= cursor), size


def exchanged(local: DataFrame, relay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides after a handshake: the local log takes the relay's events, then the relay what it lacks."""
    mine, _ = merged(local, relay)
    theirs, _ = merged(relay, mine)
    return mine, theirs


def sidecar(df: DataFrame) -> DataFrame:
    """Revocations of a JSON-lines text (column raw) in columns; lines that do not parse are left out."""
    return df.select(F.from_json("raw", SIGNED).alias("e")).filter("e.hash is not null and e.prev is not null").select("e.*")
