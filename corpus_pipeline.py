"""From raw documents to packed sequences: each stage keeps what its operator decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import stages
from reviewlake.llm.common import stage, table

#: (name, function) in order; a function takes (spark, docs, sf_dir), all but the last return docs' columns.
STAGES = stages.STAGES
#: Models and tokenizers are beyond SQL; the tests hold run() against the single operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
