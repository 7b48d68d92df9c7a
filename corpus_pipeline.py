"""The corpus pipeline: documents to packed sequences, by five of the subpackage's operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the
shared folder and hands the reread table to the next. All but the last return the columns of documents, in their
order, whatever other columns there are and whatever their names.

Null and empty texts, long texts, ties, repeated rows and empty tables: language drops texts without a letter, null
and empty ones among them; near_duplicates keeps one of the rest that are alike, of repeated rows one; repeats leaves
a null text null and never drops a row; benchmarks judges repeated rows alike; packs makes one end token of a text
without any. Texts are read whole; an empty table stays empty through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, langid, near_copies, packing, suffix_dedup
from weftline.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: keeps documents whose language is told."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: keeps one document of each group of near copies (5-word shingles of Jaccard >= 0.8), that of the smallest
    id. Fingerprints are compared in tiles, and each candidate is confirmed on the whole texts."""
    return near_copies.keep_one(docs, Scratch(spark, "near"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: cuts repeated bytes out of the texts; all documents stay, n_chars follows the text."""
    cut = suffix_dedup.without_repeats(docs, Scratch(spark, "repeats"))
    return cut.selectExpr(*[f"cast(length(text) as {docs.schema[c].dataType.simpleString()}) AS {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing: drops contaminated documents."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Optimal length buckets: packs the tokens of all that is left."""
    return packing.pack_documents(docs, Scratch(spark, "packs"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmarks", benchmarks),
    ("packs", packs),
]

#: Language ID, fingerprints and packing are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. A stage's own tables go once its result is written, and that once the next
    stage's is."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = Scratch.mark()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.sweep(mark)
        if before is not None:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
