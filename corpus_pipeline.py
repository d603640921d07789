"""A corpus pipeline of five stages; each reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skycensus.llm import mixing, quality, sentencepiece_dropout, simhash, toxicity
from skycensus.llm.common import drop_folder, shared_dir, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality classifier", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("mixing to target weights", mixing.stage),
    ("sentencepiece encoding", sentencepiece_dropout.stage),
]
#: No SQL: classifiers and segmentations are learned or hashed; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            drop_folder(spark, f"{place}/{k - 1}")
    return docs
