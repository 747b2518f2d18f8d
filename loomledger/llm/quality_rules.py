"""Quality rules whose cutoffs adapt to each language and source.

Base rules are fixed. The adaptive rules count four things in a document and
put the rate of each (per word, per line) into a mergeable quantile sketch per
(lang, source): counts in logarithmic buckets, so that partial sketches add up
to the sketch of the union, and any quantile is known to 2 % of its value. From
the group's sketch comes the rate that a sound document may reach,

    median + FENCE * max(median - lower quartile, upper quartile - median)

where the upper range is no wider than in the language's and in the whole
sketch, so that a group may hold nearly half junk without loosening its own
rule. A document of size n is allowed the count that this rate gives it, Z
standard deviations of such a count, and Z * Z events for every typical size
(the group's median), since a sketch of such documents cannot tell rarer ones
from none. Quantiles of small groups are drawn toward their language's, and
those toward everything's, as if PRIOR documents of the wider sketch had been
seen too; there is no size at which another rule sets in.

Defined cases: null or empty text has no words and fails the base rule; null
lang or source is a group of its own (null-safe join); repeated rows are judged
each, and so are rows of one id or without one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import space_words, written

ACCURACY = 0.02
#: Documents of the wider sketch that each group has seen besides its own.
PRIOR = 50
FENCE = 3.0
Z = 3.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: What is counted, and the size it is counted against; a repeated window is three words.
MEASURES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words / 3", "n_words"), "word_chars": ("word_chars", "n_words")}
SIZES = ("n_words", "n_lines")
#: Groups whose cutoffs are broadcast; beyond it they are joined by shuffle, each group dealt over SALTS tasks.
BROADCAST_GROUPS = 100_000
SALTS = 32
_GROWTH = (1 + ACCURACY) / (1 - ACCURACY)
_FLOOR = 1e-4


def features(docs: DataFrame, *extra: Column) -> DataFrame:
    """Per row: doc_id, lang, source, the counts that the rules read, all by built-in expressions, and what `extra` names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id", "lang", "source", *extra,
        space_words(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(F.regexp_replace(line, r"[\x09-\x0D]+", " "))) > 0).alias("lines"),
    )
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    base = base.withColumn("windows", F.slice(hashes, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))))
    return base.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *base.columns[3 : 3 + len(extra)],
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows"))).alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort (hash, place), keep equal neighbours, add up the places' cover."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    hash_at = lambda a, i: F.get(a, i)["h"]
    return F.aggregate(
        F.array(placed),
        F.lit(0).cast("long"),
        lambda acc, a: F.aggregate(
            F.array_sort(F.transform(F.filter(a, lambda x, i: ((i > 0) & (hash_at(a, i - 1) == x["h"])) | ((i < n - 1) & (hash_at(a, i + 1) == x["h"]))), lambda x: x["i"])),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n")),
            lambda s: s["n"],
        ),
    )


def rates() -> dict[str, Column]:
    """What is sketched: the rate of each measure, and sizes."""
    return {m: F.expr(x) / F.greatest(F.col(n), F.lit(1)) for m, (x, n) in MEASURES.items()} | {n: F.col(n).cast("double") for n in SIZES}


def bucket(value: Column) -> Column:
    """Index of the sketch's logarithmic bucket; all up to 0.0001 share bucket 0."""
    return F.when(value <= _FLOOR, 0).otherwise(F.ceil(F.log(value / _FLOOR) / math.log(_GROWTH))).cast("int")


def bucket_value(index: Column) -> Column:
    """The value that a bucket stands for."""
    return F.when(index == 0, 0.0).otherwise(_FLOOR * F.pow(F.lit(_GROWTH), index) * 2 / (1 + _GROWTH))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketch of each group, pre-aggregated before its one shuffle."""
    each = counts.filter("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in rates().items()])).alias("x"))
    return each.groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def _level(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys and ratio: total and the three quartiles."""
    rows = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    hist = rows.groupBy(*keys, "ratio").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("hist"), F.sum("n").alias("total"))
    return hist.select(*keys, "ratio", "total", *[_quantile(F.col("hist"), F.col("total"), q).alias(name) for name, q in QUARTILES.items()])


QUARTILES = {"lo": 0.25, "mid": 0.5, "hi": 0.75}


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(_lang, _source, allowed rate of each measure, typical sizes): one row per group."""
    whole = {r["ratio"]: r for r in _level(sketch, []).collect()}  # six rows
    pick = lambda q: F.coalesce(*[F.when(F.col("ratio") == k, F.lit(float(r[q]))) for k, r in whole.items()], F.lit(0.0))
    drawn = lambda own, n, wide: (n * own + PRIOR * wide) / (n + PRIOR)
    by_lang = _level(sketch, ["lang"]).select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"), *[drawn(F.col(q), F.col("total"), pick(q)).alias(f"lang_{q}") for q in QUARTILES])
    own = _level(sketch, ["lang", "source"])
    own = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r")))
    own = own.select("lang", "source", "ratio", "lang_mid", "lang_hi", *[drawn(F.col(q), F.col("total"), F.col(f"lang_{q}")).alias(q) for q in QUARTILES])
    up = F.least(F.col("hi") - F.col("mid"), F.col("lang_hi") - F.col("lang_mid"), pick("hi") - pick("mid"))
    own = own.select("lang", "source", "ratio", "mid", (F.col("mid") + FENCE * F.greatest(F.col("mid") - F.col("lo"), up)).alias("rate"))
    of = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c)))
    return own.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*[of(m, "rate").alias(f"max_{m}") for m in MEASURES], *[of(n, "mid").alias(f"typical_{n}") for n in SIZES])


def _quantile(hist: Column, total: Column, q: float) -> Column:
    """Value of the first bucket at which the running count reaches q of the total."""
    found = F.aggregate(
        hist,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("at")),
        lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.when(s["at"].isNull() & (s["n"] + b["n"] >= total * q), b["bucket"]).otherwise(s["at"]).alias("at")),
        lambda s: s["at"],
    )
    return bucket_value(found)


def _counted(docs: DataFrame, *extra: Column) -> DataFrame:
    rows = features(docs, *extra)
    return written(rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))), "quality_counts")


def _with_verdict(counts: DataFrame) -> DataFrame:
    """counts plus the group's cutoffs and `kept`."""
    limits = cutoffs(sketches(counts))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = counts
    if counts.select("lang", "source").distinct().count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
        limits = limits.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.col("_salt") == F.col("_salt_of")
    passes = ~F.col("base_failed")
    for m, (x, n) in MEASURES.items():
        due = F.col(f"max_{m}") * F.col(n)
        allowed = due + Z * F.sqrt(due) + Z * Z * F.greatest(F.lit(1.0), F.col(n) / F.col(f"typical_{n}"))
        passes &= F.coalesce(F.expr(x) <= allowed, F.lit(True))
    return rows.join(limits, same, "left").select(counts["*"], *[f"max_{m}" for m in MEASURES], passes.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs: the counts, base_failed, the rates that its group allows, and kept."""
    return _with_verdict(_counted(docs))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of docs that pass, with docs' own columns. Each row has its own verdict, whatever its id."""
    return _with_verdict(_counted(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_of_row"))).filter("kept").select("_of_row.*")
