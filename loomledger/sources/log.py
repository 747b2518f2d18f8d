"""JSON-lines logs: scan with recovery, markers, quarantine, sweeping and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomledger.functions.canonical import canonical_json, quoted
from loomledger.operators.neighbours import before
from loomledger.schema import EVENT, GENESIS


#: Where a line stands: its file's block, in the order of which a file is read.
WHERE = ("_metadata.file_path AS file", "_metadata.file_block_start AS block")
#: What counts as blank beyond ASCII.
_BLANK = r"^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*$"


def placed(raw: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(log, pos, raw): every line that is not blank with its place from 0. Files are split; a split's places follow the counts of those before it.

    raw: log, file, block, raw, and with segments (log, commit, behind: lines before it) commit; then a log is its segments' lines in their order.
    """
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select("file", "block", ahead.alias("ahead"))
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("within", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1)
    rows = rows.join(ahead, ["file", "block"])
    rows = rows.join(segments, ["log", "commit"]) if segments is not None else rows.withColumn("behind", F.lit(0))
    return rows.select("log", (F.col("behind") + F.col("ahead") + F.col("within")).alias("pos"), "raw").filter(~F.col("raw").rlike(_BLANK))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, pos, raw): every line of every file, each a log of its own."""
    raw = spark.read.text(path, lineSep="\n").selectExpr(*WHERE, "value AS raw")
    return placed(raw.withColumn("log", F.col("file")))


@F.udf(T.StringType(), useArrow=True)
def _second_chance(text):
    """What Spark's parser refuses but JSON allows: doubled keys, of which the last counts."""
    return None if text is None else canonical_json(text)


def _is_marker(v: Column, word: str | None) -> Column:
    """A marker by its typed fields; `word`: what its `marker` field must say, any text if not given."""
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    says = kind("marker") == "STRING"
    if word is not None:
        says &= F.try_variant_get(v, "$.marker", "string") == word
    typed = (kind("tip") == "STRING") & (kind("truncated_before") == "BIGINT") & (kind("next_seq") == "BIGINT")
    return F.coalesce(says & typed & (kind("v") == "BIGINT") & (F.try_variant_get(v, "$.v", "int") == 1), F.lit(False))


def scanned(spark: SparkSession, path: str, word: str | None = None) -> DataFrame:
    """Lines with `text` (what to parse), `state` (event, marker, torn (bad last line) or bad) and `gap`: the first good event after bad lines.

    A line that is JSON but no object is bad. A marker ends a run of bad lines.
    """
    return judged(lines(spark, path), word)


def judged(rows: DataFrame, word: str | None = None) -> DataFrame:
    """scanned() of lines that have their places."""
    rows = rows.withColumn("_v", F.try_parse_json("raw"))
    again = _second_chance(F.when(F.col("_v").isNull(), F.col("raw")))
    rows = rows.withColumn("text", F.when(F.col("_v").isNull(), again).otherwise(F.col("raw")))
    rows = rows.withColumn("_v", F.coalesce("_v", F.try_parse_json("text")))
    bad = ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    ends = rows.groupBy("log").agg(F.max("pos").alias("_end"))
    rows = rows.join(ends, "log")
    state = F.when(_is_marker(F.col("_v"), word), "marker").when(bad & (F.col("pos") == F.col("_end")), "torn").when(bad, "bad").otherwise("event")
    rows = before(rows.select("log", "pos", "raw", "text", state.alias("state")), "log", "pos", "_before", "state")
    gap = (F.col("state") == "event") & F.coalesce(F.col("_before.state") == "bad", F.lit(False))
    return rows.withColumn("gap", gap).drop("_before")


def events(scan: DataFrame) -> DataFrame:
    """The scan's events in columns, with log, pos and gap. A field of another type than its own reads as null; whole numbers may be
    written with a fraction of zero. The payload stays JSON text of its own kind: one that is a string stays a string's literal."""
    v, e = F.parse_json("text").alias("v"), F.from_json("text", EVENT).alias("e")
    rows = scan.filter("state = 'event'").select("log", "pos", "gap", v, e)
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    out = []
    for f in (x.split() for x in EVENT.split(", ")):
        if len(f) < 2 or "<" in f[1]:
            continue
        own = F.col(f"e.{f[0]}")
        if f[0] == "payload":
            own = F.when(kind("payload") == "STRING", quoted(own)).otherwise(own)
        elif f[1] == "string":
            own = F.when(kind(f[0]) == "STRING", own)
        else:
            number = F.try_variant_get("v", f"$.{f[0]}", "double")
            own = F.when(kind(f[0]) == "BIGINT", own).when(kind(f[0]).rlike("^(DOUBLE|FLOAT|DECIMAL)") & (number == F.floor(number)), number.try_cast("long"))
        out.append(own.alias(f[0]))
    return rows.select("log", "pos", "gap", *out, "e.countersignatures")


def quarantine(scan: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(line, sha, raw) of unreadable lines, once per content and never again what is known."""
    bad = scan.filter("state in ('bad', 'torn')").select((F.col("pos") + 1).alias("line"), F.sha2("raw", 256).alias("sha"), F.when(F.col("state") == "torn", F.concat("raw", F.lit(" /* torn tail, truncated on open */"))).otherwise(F.col("raw")).alias("raw"))
    bad = bad.groupBy("sha").agg(F.min(F.struct("line", "raw")).alias("x")).select("x.line", "sha", "x.raw")
    return bad if known is None else bad.join(known.select("sha"), "sha", "left_anti")


def markers(scan: DataFrame) -> DataFrame:
    """Per log its last marker: log, truncated_before, tip, next_seq."""
    last = scan.filter("state = 'marker'").groupBy("log").agg(F.max_by("text", "pos").alias("text"))
    return last.select("log", F.from_json("text", "truncated_before long, tip string, next_seq long").alias("m")).select("log", "m.*")


def tips(scan: DataFrame) -> DataFrame:
    """Per log where it goes on: log, max_seq (one less than the next, even if all events are swept) and last_hash."""
    last = events(scan).groupBy("log").agg(F.max("seq").alias("_seq"), F.max_by("hash", "pos").alias("_hash"))
    logs = scan.select("log").distinct()
    rows = logs.join(last, "log", "left").join(markers(scan), "log", "left")
    return rows.select("log", F.greatest(F.coalesce("_seq", F.lit(0)), F.coalesce(F.col("next_seq") - 1, F.lit(0))).alias("max_seq"), F.coalesce("_hash", "tip", F.lit(GENESIS)).alias("last_hash"))


def after(scan: DataFrame, seq: int) -> DataFrame:
    """The scan's events behind a seq."""
    return events(scan).filter(F.col("seq") > seq)


def swept_lines(scan: DataFrame, seals: DataFrame, word: str) -> DataFrame:
    """(log, pos, raw): what each log keeps below its seal (log, sealed): unreadable lines, later events, and at pos -1 a new marker.

    Old markers go. A log from which nothing is removed stays as it is.
    """
    seq = F.get_json_object("text", "$.seq").try_cast("long")
    rows = scan.join(seals.select("log", "sealed"), "log", "left").withColumn("_seq", F.when(F.col("state") == "event", seq))
    rows = rows.withColumn("_gone", F.coalesce(F.col("_seq") <= F.col("sealed"), F.lit(False)))
    gone = rows.filter("_gone").groupBy("log").agg(F.max("sealed").alias("sealed"), F.max_by(F.get_json_object("text", "$.hash"), F.struct("_seq", "pos")).alias("tip"))
    text = F.to_json(F.struct(F.lit(1).alias("v"), F.lit(word).alias("marker"), (F.col("sealed") + 1).alias("truncated_before"), "tip", (F.col("sealed") + 1).alias("next_seq")))
    kept = rows.filter("not _gone").join(gone.select("log", F.lit(True).alias("_swept")), "log", "left").filter("state <> 'marker' or _swept is null")
    return kept.select("log", "pos", "raw").unionByName(gone.select("log", F.lit(-1).cast("long").alias("pos"), text.alias("raw")))
