"""Evidence rows with ids by content, and checks that a report refers to these and no others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id


def source_evidence(messages: DataFrame, campaign: str = "campaign_id") -> DataFrame:
    """A row for each source message: evidence_id, evidence_type, message_id, community_id, source_text."""
    return messages.select(
        stable_id("evidence_", F.lit("source_message"), F.col(campaign), F.col("community_id"), F.col("message_id")).alias("evidence_id"), F.lit("source_message").alias("evidence_type"),
        F.col(campaign).alias("analysis_campaign_id"), "community_id", "message_id", F.col("text").alias("source_text"),
    )


def evidence_id(message_id: Column, community_id: Column, campaign_id: Column | None = None) -> Column:
    """The id of the evidence row that source_evidence() gives for a message."""
    return stable_id("evidence_", F.lit("source_message"), F.lit(None).cast("string") if campaign_id is None else campaign_id, community_id, message_id)


def referring(records: DataFrame, messages: str, community: str = "community_id") -> DataFrame:
    """records with evidence_ids, sorted and each once, instead of their array of message ids."""
    ids = F.array_sort(F.array_distinct(F.transform(messages, lambda m: evidence_id(m, F.col(community)))))
    return records.withColumn("evidence_ids", F.coalesce(ids, F.array().cast("array<string>"))).drop(*([messages] if messages != "evidence_ids" else []))


def union_of_evidence(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, evidence_ids): all ids that records refer to, sorted and each once."""
    return records.select(*by, F.explode("evidence_ids").alias("e")).groupBy(*by).agg(F.array_sort(F.collect_set("e")).alias("evidence_ids"))


def merge_evidence(parts: list[DataFrame]) -> DataFrame:
    """All rows, each id once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["evidence_id"])


def integrity(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """(problem, evidence_id): ids referred to that aren't there, and those there that nothing refers to."""
    refs, ids = references.select("evidence_id").distinct(), evidence.select("evidence_id").distinct()
    lost = refs.join(ids, "evidence_id", "left_anti").select(F.lit("missing").alias("problem"), "evidence_id")
    return lost.unionByName(ids.join(refs, "evidence_id", "left_anti").select(F.lit("unreferenced").alias("problem"), "evidence_id"))
