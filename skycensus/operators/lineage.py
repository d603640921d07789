"""The folder that all nodes share: cutting lineage by checkpoint files, and places for tables and files between two steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where none is set and all runs on it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """df dealt by columns over as many tasks as there are cores: a small file is one task, however much work its rows are."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), *by)
