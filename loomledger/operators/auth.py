"""Who may do what: capability tokens, grants, countersignatures, and the gate that pulled events pass.

Each check is a ladder of conditions over joined registries; signatures are
verified only on rows that no cheaper condition has refused. Registries and
revocations are broadcast up to a counted size, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomledger.functions.canonical import event_hash, quoted
from loomledger.functions.ed25519 import holds
from loomledger.functions.payload import field, kind_of, number

#: Default lifetimes of a grant and of a capability token.
GRANT_MS = 24 * 3600 * 1000
CAPABILITY_MS = 15 * 60 * 1000
BROADCAST_ROWS = 100_000
TOKEN = "struct<id:string,deviceId:string,scopes:array<string>,issuedAt:bigint,expiresAt:bigint,notBefore:bigint,signature:string>"
GRANT = "struct<id:string,deviceId:string,scopes:array<string>,issuedBy:string,issuedAt:bigint,expiresAt:bigint,signature:string>"


def listed(rows: DataFrame, keys: DataFrame, on: Column, name: str, *more: str) -> DataFrame:
    """rows plus `name` (on is among keys' first column) and keys' columns `more`; every row once."""
    key = keys.columns[0]
    keys = keys.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).alias(f"_{name}"), *more)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return rows.join(keys, on == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over all tasks: a signature costs far more than its bytes tell, and a small file is one task's."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _object(**parts: Column) -> Column:
    out = [F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *out), F.lit("}"))


def token_text(t: Column) -> Column:
    """The bytes that a device signs: fixed key order, sorted scopes, notBefore only where it is set."""
    return _object(
        id=quoted(t["id"]), deviceId=quoted(t["deviceId"]), scopes=F.to_json(F.array_sort(t["scopes"])),
        issuedAt=t["issuedAt"].cast("string"), expiresAt=t["expiresAt"].cast("string"), notBefore=t["notBefore"].cast("string"),
    )


def grant_text(g: Column) -> Column:
    """The bytes that an authority signs."""
    return _object(
        id=quoted(g["id"]), deviceId=quoted(g["deviceId"]), scopes=F.to_json(F.array_sort(g["scopes"])),
        issuedBy=quoted(g["issuedBy"]), issuedAt=g["issuedAt"].cast("string"), expiresAt=g["expiresAt"].cast("string"),
    )


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def authorized(requests: DataFrame, registry: DataFrame, devices_gone: DataFrame, tokens_gone: DataFrame) -> DataFrame:
    """requests (token, scope, now in ms) plus `refused`, the first reason or null.

    registry: device_id, pem. devices_gone and tokens_gone: one column of ids.
    A token may be used before issuedAt (not before notBefore), and up to expiresAt.
    """
    t = F.col("token")
    rows = listed(requests, registry.select("device_id", F.col("pem").alias("_pem")), t["deviceId"], "_known", "_pem")
    rows = listed(rows, devices_gone, t["deviceId"], "_device_gone")
    rows = listed(rows, tokens_gone, t["id"], "_token_gone")
    fit = _true((t["id"] != "") & (t["expiresAt"] > t["issuedAt"]) & (F.col("now") <= t["expiresAt"]))
    fit &= F.coalesce(F.col("now") >= t["notBefore"], F.lit(True)) & _true(F.array_contains(t["scopes"], F.col("scope")))
    ask = fit & F.col("_known") & ~F.col("_device_gone") & ~F.col("_token_gone")
    rows = rows.withColumn("_signed", holds(F.col("_pem"), token_text(t), t["signature"], ask))
    reason = (
        F.when(t.isNull(), "missing capability token")
        .when(F.col("_device_gone"), F.concat(F.lit("device revoked: "), t["deviceId"]))
        .when(F.col("_token_gone"), F.concat(F.lit("token revoked: "), t["id"]))
        .when(~F.col("_known"), F.concat(F.lit("unknown device: "), t["deviceId"]))
        .when(~F.col("_signed"), F.concat(F.lit("capability rejected for "), F.col("scope")))
    )
    return rows.withColumn("refused", reason).select(*requests.columns, "refused")


def granted(requests: DataFrame, authority_pem: str, grants_gone: DataFrame) -> DataFrame:
    """requests (grant, scope, now in ms) plus `refused`. A grant holds from issuedAt to expiresAt, both included."""
    g = F.col("grant")
    rows = listed(requests, grants_gone, g["id"], "_gone")
    fit = _true((g["expiresAt"] > g["issuedAt"]) & F.col("now").between(g["issuedAt"], g["expiresAt"]) & F.array_contains(g["scopes"], F.col("scope"))) & ~F.col("_gone")
    rows = rows.withColumn("_signed", holds(F.lit(authority_pem), grant_text(g), g["signature"], fit))
    reason = F.when(g.isNull(), "missing scope grant").when(~F.col("_signed"), F.concat(F.lit("grant rejected for "), F.col("scope")))
    return rows.withColumn("refused", reason).select(*requests.columns, "refused")


def countersigned(events: DataFrame, registry: DataFrame, threshold: int) -> DataFrame:
    """(id, valid, met) per event: distinct registered devices whose countersignature of an untampered event holds.

    events: hash's fields, hash, countersignatures (deviceId, signatureHex); ids are unique.
    A threshold that the registry can never meet is an error.
    """
    size = registry.select("device_id").distinct().count()
    if isinstance(threshold, bool) or not isinstance(threshold, int) or not 1 <= threshold <= size:
        raise ValueError(f"threshold {threshold} out of range 1..{size}")
    votes = events.select("id", "hash", (event_hash() == F.col("hash")).alias("_whole"), F.explode("countersignatures").alias("c"))
    votes = listed(votes, registry.select("device_id", F.col("pem").alias("_pem")), F.col("c.deviceId"), "_known", "_pem")
    votes = spread(votes).withColumn("_ok", holds(F.col("_pem"), F.col("hash"), F.col("c.signatureHex"), F.col("_known") & _true(F.col("_whole"))))
    tallied = votes.filter("_ok").select("id", "c.deviceId").distinct().groupBy("id").agg(F.count("*").alias("valid"))
    rows = events.select("id").join(tallied, "id", "left").select("id", F.coalesce("valid", F.lit(0)).alias("valid"))
    return rows.withColumn("met", F.col("valid") >= threshold)


def authentic(events: DataFrame, registry: DataFrame | None, limit: float | None = None, threshold: int = 1) -> DataFrame:
    """events plus `authentic`: signed by a registered origin and not tampered with; entries of `limit` or more also countersigned.

    Without a registry all pass. A null or empty signature fails.
    """
    if registry is None:
        return events.withColumn("authentic", F.lit(True))
    rows = listed(spread(events), registry.select("device_id", F.col("pem").alias("_pem")), F.col("device_id"), "_known", "_pem")
    ask = F.col("_known") & _true(event_hash() == F.col("hash")) & _true(F.col("signature") != "")
    rows = rows.withColumn("authentic", holds(F.col("_pem"), F.col("hash"), F.col("signature"), ask))
    if limit is None:
        return rows.select(*events.columns, "authentic")
    v = field(F.try_parse_json("payload"), "value")
    value = number(kind_of(v), F.trim(v.try_cast("string")))
    rows = rows.withColumn("_high", (F.col("type") == "entry") & _true((value >= limit) & (value < float("inf")) & ~F.isnan(value)))
    met = countersigned(rows.filter("_high"), registry, threshold).select("id", "met")
    rows = rows.join(met, "id", "left").withColumn("authentic", F.col("authentic") & (~F.col("_high") | _true(F.col("met"))))
    return rows.select(*events.columns, "authentic")
