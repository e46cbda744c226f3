"""The corpus pipeline: quality, near duplicates, decontamination, personal identifiers, packing, in this order.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a DataFrame; run() writes
each as Parquet into the shared folder and reads it again as the next one's docs. All but the last return the columns of
documents. Rows and texts are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kakari.checkpoint import remove, temporary
from kakari.llm import decontaminate, neardup, packing, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 4) rejects go."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (operator 2) stays."""
    return neardup.drop_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (operator 1) go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers (operator 10) are replaced by their kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences (operator 5)."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("identifiers", without_identifiers), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = temporary(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if n:
            remove(spark, f"{at}/{STAGES[n - 1][0]}")  # nothing reads it any more
    return docs
