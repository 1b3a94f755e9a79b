"""A corpus made ready in five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import shared_dir
from threadloom.llm.decontaminate import remove_contaminated
from threadloom.llm.exact_dedup import drop_exact_duplicates
from threadloom.llm.near_dedup import drop_near_duplicates
from threadloom.llm.segmentation import encoded
from threadloom.llm.toxicity import fit_toxicity, remove_toxic
from threadloom.session import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    ship(spark)
    return remove_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z's case, the largest doc_id stays."""
    ship(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that reach each other over a similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    ship(spark)
    return drop_near_duplicates(docs, shingle_words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    ship(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled segmentation into pieces."""
    ship(spark)
    return encoded(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("segmentation", segmentation)]

#: No SQL gives the rows of the first and the last stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read again."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("errorifexists").parquet(f"{at}/{k}_{name}")
        docs = spark.read.parquet(f"{at}/{k}_{name}")
    return docs
