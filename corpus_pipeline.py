"""The corpus pipeline: rules, near duplicates, repeated passages, source mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oathmill.llm import stages
from oathmill.llm.shared import Stage, documents

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.apply_quality_rules),
    ("simhash_near_dedup", stages.drop_near_duplicates),
    ("substring_dedup", stages.remove_repeated_passages),
    ("source_mix", stages.mix_sources),
    ("sentencepiece", stages.tokenize),
]

#: Pivotal rounding, adaptive cutoffs and tokenization have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Stage(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
