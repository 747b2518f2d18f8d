"""Benchmark decontamination by a distributed positional inverted index.

1. Store postings (document, place, term) of every benchmark word in every
   document; an end marker per document carries its length.
2. Windows of equal words are one. Of each window take the two rarest terms by
   posting count, fetch only their lists, and shift each place by the term's
   offset: lists that meet at one place are a candidate. Equal pairs of terms at
   one distance are one lookup, however many windows have them, so that a text
   and an item that repeat themselves meet no more often than the text is long.
3. Look the words at a candidate's place up among the windows: exact matches.
   Where the two rarest terms of a window stand in a document at a distance that
   differs from the window's by SLOP words or less, the item is near.

Everything is built-in DataFrame functions. Broadcasts are made only of tables
counted first (BROADCAST_ROWS, BROADCAST_WORDS); beyond that the rows of a word
are dealt over SALTS tasks.

Defined cases: a null or empty text has no words and no hits; an item of fewer
than WINDOW words is one window, one without words none; a window of one word is
near where it is exact; repeated rows and repeated ids are answered row by row
(rows are told apart by id and text); null item ids count as items named by the
empty string; rows with a null id are judged like any other; empty tables give
empty or hit-free results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import alnum_words, written

WINDOW = 10
#: Words by which the distance of a window's two rare terms may be off and still count as near.
SLOP = 8
BROADCAST_ROWS = 200_000
#: Words in the lists of a table that is broadcast.
BROADCAST_WORDS = 2_000_000
SALTS = 32
_END = ""


def _small(df: DataFrame, words: Column | None = None) -> DataFrame | None:
    """df with a broadcast hint if counts show that it is small: its rows, and its words where it has lists of them; else None."""
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.lit(0) if words is None else words), F.lit(0)).alias("words")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and size["words"] <= BROADCAST_WORDS else None


def _looked_up(rows: DataFrame, table: DataFrame, key: str, deal: list[str], words: Column | None = None) -> DataFrame:
    """rows joined to a table on a key that may be hot: by broadcast, or with each key's rows dealt by other columns."""
    small = _small(table, words)
    if small is not None:
        return rows.join(small, key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*deal), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, words, k): items that have words; k is their window length."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("words"))
    return rows.filter(F.size("words") > 0).withColumn("n", F.monotonically_increasing_id()).withColumn("k", F.least(F.lit(WINDOW), F.size("words")))


def index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored postings (doc_id, mark (hash of the text), term, place) and the terms of words. Term 0 marks a document's end, its place the word count."""
    vocabulary = written(items.select(F.explode("words").alias("word")).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term")), "bench_terms")
    vocabulary = vocabulary.unionByName(docs.sparkSession.createDataFrame([(_END, 0)], "word string, term long"))
    tokens = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.array_append(alnum_words(F.col("text")), _END)).alias("place", "word"))
    return written(_looked_up(tokens, vocabulary, "word", ["mark", "place"]).select("doc_id", "mark", "term", "place"), "bench_postings"), vocabulary


def windows(items: DataFrame, postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(item, gram, k, left, right, delta, off): every window whose words all documents together have, with its two rarest terms.

    `right` stands delta words after `left` and `off` words after the window's start; a window of one word has no right.
    """
    frequency = postings.filter("term > 0").groupBy("term").agg(F.count("*").alias("df"))
    places = items.select("n", "item", "k", F.posexplode("words").alias("at", "word")).join(vocabulary, "word").join(frequency, "term", "left")
    by_item = places.groupBy("n", "item", "k").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df"), "term", "word"))).alias("p"))
    each = by_item.select("item", "k", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("k")), lambda s: F.slice("p", s + 1, F.col("k")))).alias("w"))
    each = each.select(
        "item", "k", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("gram"),
        F.array_sort(F.transform("w", lambda x, i: F.struct(x["df"].alias("df"), i.alias("at"), x["term"].alias("term")))).alias("by_df"),
    ).distinct().filter(F.col("by_df")[0]["df"] > 0)
    a, b = F.get("by_df", F.lit(0)), F.get("by_df", F.lit(1))
    return each.select("item", "gram", "k", a["term"].alias("left"), b["term"].alias("right"), F.coalesce(b["at"] - a["at"], F.lit(0)).alias("delta"), F.coalesce(b["at"], a["at"]).alias("off"))


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lengths (one row per document row), exact spans and items per document, and the number of near items per document."""
    items = written(items_of(benchmark), "bench_items")
    postings, vocabulary = index(docs, items)
    grams = written(windows(items, postings, vocabulary), "bench_windows")
    probe = ["left", "right", "delta"]
    probes = written(grams.select(*probe).distinct().withColumn("probe", F.monotonically_increasing_id()), "bench_probes")
    same_probe = F.col("left").eqNullSafe(F.col("_left")) & F.col("right").eqNullSafe(F.col("_right")) & (F.col("delta") == F.col("_delta"))
    named = written(grams.join(probes.select(*[F.col(c).alias(f"_{c}") for c in probe], "probe"), same_probe).select("item", "gram", "k", "off", "probe"), "bench_probed")

    one = F.col("right").isNull()
    left = F.struct(F.col("left").alias("term"), F.col("delta").alias("shift"), F.lit(1).alias("l"), one.cast("int").alias("r"), F.lit(0).alias("own"))
    twin = ((F.col("left") == F.col("right")) & (F.abs("delta") <= SLOP)).cast("int")  # one place is then both terms' and must not meet itself
    right = F.struct(F.col("right").alias("term"), F.lit(0).alias("shift"), F.lit(0).alias("l"), F.lit(1).alias("r"), twin.alias("own"))
    lookups = probes.select("probe", F.explode(F.when(one, F.array(left)).otherwise(F.array(left, right))).alias("x")).select("probe", "x.*")

    key = ["doc_id", "mark", "probe"]
    met = _looked_up(postings, lookups, "term", ["mark", "place"]).select(*key, (F.col("place") + F.col("shift")).alias("pos"), "l", "r", "own")
    met = met.repartition(*key).groupBy(*key, "pos").agg(*[F.max(c).alias(c) for c in ("l", "r", "own")])
    around = F.sum("l").over(Window.partitionBy(*key).orderBy("pos").rangeBetween(-SLOP, SLOP))
    met = met.withColumn("around", around - F.col("own")).filter((F.col("r") == 1) & ((F.col("l") == 1) | (F.col("around") > 0)))
    met = written(met.select(*key, "pos", (F.col("l") == 1).alias("exact")), "bench_met")

    starts = named.select("probe", "off", "k").distinct()
    wanted = _looked_up(met.filter("exact"), starts, "probe", ["mark", "pos"]).select("doc_id", "mark", F.struct((F.col("pos") - F.col("off")).alias("from"), "k").alias("a"))
    wanted = written(wanted.filter("a.from >= 0").groupBy("doc_id", "mark").agg(F.collect_set("a").alias("wanted")), "bench_candidates")
    small = _small(wanted, F.size("wanted"))

    # the text's words are a lambda's variable, so that they are split once a row and not once a candidate
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    to = wanted if small is None else small
    texts = marked.join(to, marked["doc_id"].eqNullSafe(to["doc_id"]) & (marked["mark"] == to["mark"])).select(marked["doc_id"], marked["mark"], "text", "wanted")
    grams_at = lambda words: F.transform(F.filter("wanted", lambda a: a["from"] + a["k"] <= F.size(words)), lambda a: F.struct(a["from"].alias("from"), (a["from"] + a["k"]).alias("to"), F.array_join(F.slice(words, a["from"] + 1, a["k"]), " ").alias("gram")))
    found = texts.select("doc_id", "mark", F.explode(F.transform(F.array(alnum_words(F.col("text"))), grams_at)[0]).alias("g")).select("doc_id", "mark", "g.*")
    hits = written(_looked_up(found, named.select("gram").distinct(), "gram", ["mark", "from"], F.lit(WINDOW)), "bench_hits")
    spans = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    which = _looked_up(hits.select("doc_id", "mark", "gram").distinct(), named.select("gram", "item").distinct(), "gram", ["mark"], F.lit(WINDOW))
    which = which.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = _looked_up(met.select(*key).distinct(), named.select("probe", "item").distinct(), "probe", ["mark"])
    near = near.groupBy("doc_id", "mark").agg(F.count_distinct("item").alias("n_near"))
    lengths = postings.filter("term = 0").select("doc_id", "mark", F.col("place").cast("long").alias("n_words"))
    return lengths, _beside(spans, which, "inner"), near


def _beside(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Both tables' columns, joined on doc_id and mark; a null id equals a null id."""
    right = right.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["mark"] == right["_mark"]), how).drop("_id", "_mark")


def _cover(spans: Column) -> Column:
    """Words covered by spans, each counted once."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["to"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(s["end"], x["from"]))).alias("n")),
        lambda s: s["n"],
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with a near window, exact ones included)."""
    return _judged(docs, benchmark).drop("mark")


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    lengths, exact, near = matches(docs, benchmark)
    rows = _beside(_beside(lengths, exact), near)
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = _cover(F.coalesce("spans", F.array().cast(exact.schema["spans"].dataType)))
    return rows.select(
        "doc_id", "mark", "n_words", hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without any benchmark window, with docs' own columns. Each row has its own verdict, whatever its id."""
    bad = written(_judged(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("mark").alias("_bad_mark")).distinct(), "bench_bad")
    small = _small(bad)
    bad = bad if small is None else small
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_mark"]), "left_anti")
