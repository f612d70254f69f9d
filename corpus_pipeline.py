"""The corpus pipeline: quality classifier, language id, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame; all but the last
return the columns of `documents`. Between stages the rows are written as Parquet and read again.

Rows with a null or empty text or without a letter go in the first two stages; a null language is filled in, a null source is a source of
its own. Of rows with one doc_id one stays, rows without an id all stay. Empty tables give no row. Columns beyond those of
`documents` are carried up to the last stage; one with the name of an operator's result (kept, score, ...) has its values afterwards.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import cotraining, decontaminate, language_id, near_dedup, packing
from trailmark.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = cotraining.fit(spark, docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(spark, docs, model).filter("kept").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; a missing language is filled in."""
    named = language_id.identify(spark, docs, language_id.fit(spark, docs)).filter("NOT rejected")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, over five-word shingles."""
    return near_dedup.one_of_each(spark, docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 4096 tokens."""
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: Trained models and minimum hashing have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
