"""License scans by a positional index of rare licence words.

Templates are indexed as postings (word, template, place), of each template the
places whose words have the highest inverse document frequency. Every place of
such a word in a file is looked up there; postings whose file place minus
template place agree vote for one alignment; an alignment with enough votes is
compared word for word, and counts only if the template's mandatory key phrase
stands in it. A template has so many posted places that an alignment which
covers enough of it cannot miss more than would leave it the votes it needs.

All steps are built-in DataFrame functions. Document frequencies cover every
document. Texts that do not hold the first word of any phrase cannot match
and are spared the later steps; nothing else is skipped.

Defined cases: null and empty texts have no words, no labels and score 0; a
text of any length is read whole; repeated rows are scanned each; ties between
alignments of one template go to the best covered, then the earliest; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import alnum_words, written

#: Phrase and label of the base scan.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, mandatory key phrase, notice text (lower case, words only).
TEMPLATES = [
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "gnu general public license as published", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("mit", "the mit license", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
]
#: Votes an alignment needs, and share of a template's words it must then hold.
MIN_VOTES = 2
MIN_COVER = 0.8

_VOCABULARY = sorted({w for _, _, text in TEMPLATES for w in text.split()})
_HEADS = sorted({k.split()[0] if k.split()[0] != "the" else k.split()[1] for k in [*BASE, *(k for _, k, _ in TEMPLATES)]})


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    parts = phrase.split()
    hits = F.transform(words, lambda w, i: F.when((w == parts[0]) & _all(F.get(words, i + k) == p for k, p in enumerate(parts[1:], 1)), i))
    return F.array_compact(hits)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _tokens(docs: DataFrame) -> DataFrame:
    """One row per document: its word count, the licence words in it in any case, and all its words if it may hold a key phrase."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), alnum_words(F.col("text")).alias("words"))
    may = F.arrays_overlap("licence_words", F.array(*map(F.lit, _HEADS)))
    rows = rows.withColumn("licence_words", F.array_intersect("words", F.array(*map(F.lit, _VOCABULARY))))
    return rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), "licence_words", F.when(may, F.col("words")).alias("words"))


def posted(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """(word, template, place): of each template the rarest words, as many as it may miss and MIN_VOTES more."""
    out = []
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        missed = max(m for m in range(len(words) + 1) if (len(words) - m) / len(words) >= MIN_COVER)
        rarest = sorted(range(len(words)), key=lambda i: (-idf.get(words[i], float("inf")), i))
        out += [(words[i], t, i) for i in rarest[: missed + MIN_VOTES]]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: n_words, base phrase places, labels of both kinds, and the best template's cover as score."""
    spark = docs.sparkSession
    tokens = written(_tokens(docs), "licence_tokens")

    # document frequencies: at most one row per word of the fixed vocabulary
    df = tokens.select(F.explode("licence_words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    total = tokens.count()
    idf = {r["word"]: r["idf"] for r in df.select("word", F.log(F.lit(float(total + 1)) / F.col("df")).alias("idf")).collect()}
    postings = spark.createDataFrame(posted(idf), "word string, template int, at int")

    files = tokens.filter(F.col("words").isNotNull())
    lookups = files.select("row", F.posexplode("words").alias("place", "word"))
    votes = lookups.join(F.broadcast(postings), "word").groupBy("row", "template", (F.col("place") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    aligned = votes.filter(F.col("votes") >= MIN_VOTES).join(
        F.broadcast(spark.createDataFrame([(t, label, key.split(), text.split()) for t, (label, key, text) in enumerate(TEMPLATES)], "template int, label string, key array<string>, notice array<string>")), "template"
    )
    by_row = aligned.groupBy("row").agg(F.collect_list(F.struct("label", "key", "notice", "start")).alias("aligned"))

    def cover(words: Column, a: Column) -> Column:
        same = F.filter(F.transform(a["notice"], lambda w, i: F.coalesce(F.when(a["start"] + i >= 0, F.get(words, a["start"] + i)) == w, F.lit(False))), lambda x: x)
        return F.size(same) / F.size(a["notice"])

    def has_key(words: Column, a: Column) -> Column:
        span = F.array_join(F.slice(words, F.greatest(a["start"], F.lit(0)) + 1, F.size(a["notice"])), " ")
        return F.contains(F.concat(F.lit(" "), span, F.lit(" ")), F.concat(F.lit(" "), F.array_join(a["key"], " "), F.lit(" ")))

    found = F.filter(
        F.transform(F.coalesce("aligned", F.array().cast(by_row.schema["aligned"].dataType)), lambda a: F.struct(cover(F.col("words"), a).alias("cover"), a["label"].alias("label"), a["start"].alias("start"), has_key(F.col("words"), a).alias("key"))),
        lambda x: x["key"] & (x["cover"] >= MIN_COVER),
    )
    starts = F.array(*[F.struct(F.lit(label).alias("label"), _phrase_starts(F.col("words"), phrase).alias("at")) for phrase, label in BASE.items()])
    scanned = files.join(by_row, "row", "left").select("row", starts.alias("base"), found.alias("found"))
    scanned = scanned.select(
        "row",
        F.flatten(F.transform("base", lambda b: b["at"])).alias("at"),
        F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])).alias("base_labels"),
        "found",
    )
    result = tokens.select("doc_id", "row", "n_words").join(scanned, "row", "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    base_labels, found_labels = F.coalesce("base_labels", none), F.coalesce(F.transform("found", lambda x: x["label"]), none)
    return result.select(
        "doc_id", "n_words",
        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, found_labels))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["cover"])), F.when(F.size(base_labels) > 0, F.lit(0.5)), F.lit(0.0)).alias("score"),
    )
