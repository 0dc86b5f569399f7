"""From raw documents to token digests: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. ``run`` writes each stage's result as Parquet in the shared folder and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import common, decontaminate, line_dedup, near_dedup, quality_classifier, sentencepiece


def _bounded(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = docs.select("doc_id", sentencepiece.encode_digest(F.col("text"), sentencepiece.default_model(spark)).alias("x"))
    return coded.select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")


STAGES = [
    ("quality", _bounded(quality_classifier.stage)),
    ("line_dedup", _bounded(line_dedup.stage)),
    ("near_dedup", _bounded(near_dedup.stage)),
    ("decontaminate", _bounded(decontaminate.stage)),
    ("tokens", _bounded(tokens)),
]

#: zstandard sizes, MinHash and byte-pair merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
