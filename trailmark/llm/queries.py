"""The corpus operators' queries, with production parameters, and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import collocations, cotraining, decontaminate, html_extract, language_id, lexical, licenses, near_dedup, packing, pieces, quality_rules, sharding, warc
from trailmark.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words, or more, in common passages."""
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, over two-word shingles."""
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, percent=80)


def held_out() -> Column:
    """True for the documents that no language model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(spark, docs.filter(~held_out()))
    return language_id.identify(spark, docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(spark, docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(spark, docs.select("doc_id", "text", *cotraining.META[:3]), model).drop("text", *cotraining.META)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licenses.license_scan(spark, table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document after four arrivals and a compaction."""
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return warc.page_derivatives(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_texts(spark, table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens with the sources in the proportions of the corpus."""
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdicts of all documents; cutoffs from the labelled ones."""
    return quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words in each language."""
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they give."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical.ranked(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_license_scan": op5_license_scan,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_html_extraction": op8_html_extraction,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_pieces": op12_pieces,
    "op13_lexical": op13_lexical,
}
ORACLE_SQL = {
    "op5_license_scan": licenses.oracle_sql(),
    "op10_quality_rules": quality_rules.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
    "op13_lexical": lexical.oracle_sql(),
}
