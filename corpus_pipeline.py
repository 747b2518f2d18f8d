"""Corpus pipeline: training-data operators, one after the other, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomledger.llm import decontaminate, near_dedup, packing, quality_rules, secrets
from loomledger.llm._common import drop_made, made, table, written


# Every stage judges rows one by one, so that rows without an id or of one id have their own verdicts
# (near-duplicates: rows of one id are one document). Null and empty texts fail the quality rules; an empty
# table gives an empty one; extra columns are kept, whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the rules' cutoffs come from this stage's own input. Null and empty texts go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id; documents without words are groups of their own."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; those without words stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets redacted; null and empty texts as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins; one row without a bin for a document without words."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]
#: Redaction by a trained forest has no SQL. tests/llm/test_values.py compares the first three stages with SQL, each on what the SQL
#: before it kept, redaction with the spans of scan() cut in Python, and packing with each document's words and the bins' sizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before it kept, each written as Parquet and read again; a stage's scratch tables go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        begun = made()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        drop_made(spark, begun, but_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
