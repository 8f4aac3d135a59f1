"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept, written as Parquet between them.

Defined cases, for every stage: null and empty texts score as having no word (the language stage drops them, as they have no letter); texts
of any length are judged whole; repeated rows are judged alike, and the join keeps one row of an id; documents without an id are judged like others and
are no one's copy; empty tables pass as empty tables; the documents' other columns are kept, whatever their names. The rows of the mix are in no order
once written; ``mix_finish`` has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import op4_decontamination, op5_toxicity, op6_mixing, op7_language_id, op10_ngram_join
from tidelane.llm.common import release, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go."""
    return op5_toxicity.civil(docs, op5_toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no learned language, go: those that score far below the language's training texts."""
    learned = op7_language_id.learn(docs)
    return op7_language_id.speakable(docs, learned, op7_language_id.floors(docs, learned))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return op10_ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    return op4_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken; its place in the mix is ``mix_finish``."""
    return op6_mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the trained stages nor the components of the join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
