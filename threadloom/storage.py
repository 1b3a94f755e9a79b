"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, as in tests, a local master may use a local folder; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


class Steps:
    """Writes the rounds of an iterative operator, so that a plan stays short and a lost executor costs one round at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}"
        df.write.mode("errorifexists").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
