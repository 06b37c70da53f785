"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Stage functions take (spark, docs, sf_dir); each result is written as Parquet and read again as the next one's docs.
Null and empty texts fail the base quality rules and go in the first stage. Rows with a null id are judged like others.
Repeated rows stay until the third stage, which keeps one of each. Other columns, also such as clash with names used inside,
go through unchanged. Without labels only the base quality rules reject, and nothing is toxic; without benchmark items
nothing is contaminated; no documents give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm import bpe, decontaminate, near_duplicates, quality, toxicity
from rulewright.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules reject go."""
    return quality.cleaned(docs, table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' labels, finds toxic go."""
    return toxicity.cleaned(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return near_duplicates.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of the text decoded from them."""
    return bpe.digests(bpe.round_trip(docs, bpe.vocabulary_path()))


STAGES = [("quality", quality_rules), ("toxicity", toxic), ("near_duplicates", near_copies), ("decontamination", benchmark_free), ("tokens", tokens)]

#: Trained models and a tokenizer take part, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
