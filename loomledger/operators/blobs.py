"""Content-addressed blobs: references, collection and integrity; and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(content: Column) -> Column:
    return F.sha2(content, 256)


def path_of(k: Column) -> Column:
    return F.concat(F.lit("sha/"), F.substring(k, 1, 2), F.lit("/"), F.substring(k, 3, 62))


def references(content: DataFrame, column: str) -> DataFrame:
    """(key, refs, bytes): one row per distinct content."""
    rows = content.filter(F.col(column).isNotNull()).select(key(F.col(column)).alias("key"), F.octet_length(column).cast("long").alias("bytes"))
    return rows.groupBy("key").agg(F.count("*").alias("refs"), F.max("bytes").alias("bytes"))


def collect_garbage(blobs: DataFrame, refs: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(key, finding): blobs nobody refers to (orphan, unless quarantined) and references without a blob (missing)."""
    b, r = blobs.select("key").distinct().withColumn("_b", F.lit(True)), refs.filter("refs > 0").select("key").distinct().withColumn("_r", F.lit(True))
    both = b.join(r, "key", "full").join(quarantined.select("key").distinct().withColumn("_q", F.lit(True)), "key", "left")
    word = F.when(F.col("_r").isNull() & F.col("_q").isNull(), "orphan").when(F.col("_b").isNull(), "missing")
    return both.withColumn("finding", word).filter("finding is not null").select("key", "finding")


def damaged(blobs: DataFrame) -> DataFrame:
    """Keys whose content no longer hashes to them."""
    return blobs.filter(key(F.col("content")) != F.col("key")).select("key")


def put(blobs: DataFrame, refs: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs (key, content), refs (key, refs)) with new contents (content): each row is one reference, equal contents are one blob."""
    rows = content.select(key(F.col("content")).alias("key"), "content")
    new = rows.join(blobs.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return blobs.unionByName(new), counted(refs, rows.select("key", F.lit(1).cast("long").alias("refs")))


def counted(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """refs with changes (key, refs: more or fewer) added up; keys without references are gone."""
    return refs.unionByName(changes).groupBy("key").agg(F.sum("refs").alias("refs")).filter("refs > 0")


def linked(refs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, unknown): links (+1) and unlinks (-1) of known keys applied; keys without a reference are refused."""
    unknown = changes.join(refs.select("key"), "key", "left_anti").select("key").distinct()
    return counted(refs, changes.join(refs.select("key"), "key", "left_semi")), unknown


def fetched(wanted: DataFrame, blobs: DataFrame, refs: DataFrame, quarantined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, content) of wanted keys that are referenced, stored, not quarantined and whole; (key) that were found damaged and join the quarantine)."""
    rows = wanted.select("key").distinct().join(refs.select("key"), "key", "left_semi").join(quarantined.select("key"), "key", "left_anti").join(blobs, "key")
    whole = key(F.col("content")) == F.col("key")
    return rows.filter(whole).select("key", "content"), rows.filter(~whole).select("key")


def stats(blobs: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, size, refcount) of every referenced blob that is stored."""
    return refs.join(blobs.select("key", F.octet_length("content").cast("long").alias("size")), "key").select("key", "size", F.col("refs").alias("refcount"))


def quota(events: DataFrame, limit: int, estimate: int) -> DataFrame:
    """One row: bytes used, limit, and whether one more event of the estimated size still fits."""
    used = F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0).cast("long"))
    return events.agg(used.alias("used")).select("used", F.lit(limit).cast("long").alias("quota"), (F.col("used") + estimate <= limit).alias("fits"))
