"""A corpus pipeline of five of the operators; each stage takes all that its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is
written as Parquet and read again as the next one's docs. All but the last return the
columns of documents; the last adds slot, block and block_place.

Odd input, as the stages define it: quality_rules rejects null and empty texts and those of a language without any text. quality_classifier
keeps all where no row is labelled good. ngram_jaccard_join keeps rows without a doc_id or a word, and one of equal rows.
benchmark_decontamination keeps rows without a word. source_mixing takes a null source as "" and leaves out sources of weight 0 (such as
one without any word). Empty tables give empty results; other columns, whatever their names, are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spillway.llm import decontaminate, importance, jaccard, mixing, quality_rules
from spillway.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies in their language's band."""
    return quality_rules.keep(docs, read(spark, sf_dir, "labels"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes for the target."""
    return importance.keep(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.keep(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule that mixes sources to their target weights; a source that is used up leaves it."""
    return mixing.mixed(docs, exhausted="leave")


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classify),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mix),
]

ORACLE_SQL = None  # SQL can't express the models; tests/llm/test_pipeline_rows.py holds run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
