"""The corpus pipeline: from `documents` to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillpress.llm import stages
from quillpress.llm.shared import forget, materialize, table, tidy, written

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.drop_near_copies),
    ("secret_scan", stages.mask_secrets),
    ("mixing", stages.sample_mixture),
    ("packing", stages.pack_sequences),
]

#: Training a classifier, fingerprints and tokens have no SQL form: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(first, keep=1)  # what the stage wrote for itself, and its input
        tidy(spark)
    return docs
