"""Corpus preparation: stages over the documents table, each one written and
read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import bpe, common, mixing, secrets, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", simhash.stage),
    ("secrets", secrets.stage),
    ("mix", mixing.stage),
    ("bpe", bpe.stage),
]

#: Fingerprints, a trained model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
