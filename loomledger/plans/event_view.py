"""The `events` table seen as a ledger: every kind of event, undos and transitions both ahead of and behind their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, type, actor, device_id, ts_device, payload) from events; a projection only, so filters and pruning reach the scan."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    e, n = F.col("event_id"), F.col("n")
    ref = lambda x: F.concat(F.lit("e"), x.cast("string"))
    one = lambda name, x: F.concat(F.lit(f'{{"{name}":"'), x, F.lit('"}'))
    tally = lambda qty: F.concat(F.lit('{"item":"i'), (n % 20).cast("string"), F.lit('","qty":'), qty.cast("string"), F.lit("}"))
    kind = F.col("event_type")
    view = kind == "view"
    to_entry = ref((e - e % 8) + n % 8)
    to_hidden = ref((e - e % 40) + n % 4)
    rows = table(spark, sf_dir, "events").withColumn("n", k)
    return rows.select(
        (e + 1).alias("seq"),
        ref(e).alias("id"),
        F.when(kind == "purchase", "entry").when(kind == "signup", "tally.add").when(kind == "click", "tally.remove").when(kind == "error", "undo.compensate")
        .when(view & (n % 5 == 0), "entry.resolved").when(view & (n % 5 == 1), "entry.failed").when(view & (n % 5 == 2), "entry.expired")
        .when(view & (n % 5 == 3), "tombstone.hide").when(view, "tombstone.show").otherwise(kind).alias("type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"),
        F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_device"),
        F.when(kind == "purchase", F.concat(F.lit('{"value":'), F.greatest(F.floor(F.col("value") * 100 + 0.5), F.lit(1)).cast("long").cast("string"), F.lit("}")))
        .when(kind == "signup", tally(n + 1))
        .when(kind == "click", tally((n % 10 + 1) * 9))
        .when(kind == "error", one("reverses", ref(e + n % 30 - 18)))
        .when(view & (n % 5 < 3), one("event_id", to_entry))
        .when(view & (n % 5 == 3), one("hides", to_hidden))
        .when(view, one("shows", to_hidden))
        .otherwise(F.lit("{}")).alias("payload"),
    )
