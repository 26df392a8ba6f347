"""From raw documents to shards of a training mix: five stages, each written and read again.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
documents.  Importing this needs the ``tessera.llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import fresh_path
from tessera.llm.stages import STAGES

#: Fingerprints, classifiers and greedy cuts have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows go through Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
