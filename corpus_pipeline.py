"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, token shards.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs.

Defined results, at every stage: null and empty texts are documents without words, which the quality stage
rejects and every other stage keeps (the mix takes none of them); repeated rows are documents of their own,
of which the duplicate stage keeps one; null keys, sources and languages are values like others; an empty
table gives an empty result with the same columns; extra columns are carried along, whatever their names.
The quality stage takes boilerplate lines out of the texts it keeps, and counts n_chars again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgestream.llm import decontamination, jaccard_join, mixing, quality_rules, token_shards
from edgestream.llm.common import drop, drop_since, materialise, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines."""
    kept = quality_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join."""
    return jaccard_join.drop_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row for each sequence."""
    return token_shards.write_shards(docs)[0]


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The class ids and the byte-pair tokens of the last stages have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        start, before = written(), docs
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
            drop_since(start, but=(docs,))  # the stage's helper tables: its result has just been written
            drop(before)
    return docs
