"""Seed labels of messages, and repeated promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.behavior import FEEDBACK_LABELS, Message, seed_label
from .threads import with_question

#: Seconds within which a moderator's equal text is a repeat.
DUPLICATE_SECONDS = 3600


def duplicate_promotions(messages: DataFrame, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """(message_id, prior_id): moderators' messages with an equal text by the same actor, in the same campaign or none, up to `seconds` before; the latest such."""
    m = (messages if "norm" in messages.columns else with_question(messages)).where(F.col("user_role") == "moderator")
    rows = m.select("message_id", "community_id", "user_id_hash", "campaign_id", F.sha2("norm", 256).alias("k"), F.unix_micros("timestamp").alias("at"))
    back = Window.partitionBy("community_id", "user_id_hash", "campaign_id", "k").orderBy("at").rangeBetween(-seconds * 1_000_000, -1)
    return rows.withColumn("prior", F.max(F.struct("at", "message_id")).over(back)).where(F.col("prior").isNotNull()).select("message_id", F.col("prior.message_id").alias("prior_id"))


def seed_behaviors(messages: DataFrame) -> DataFrame:
    """(message_id, community_id, user_role, behavior, rule_id, confidence, evidence_ids) for every message."""
    m = messages if "asks" in messages.columns else with_question(messages)
    parent = m.select(F.col("message_id").alias("p_id"), F.col("norm").alias("p_norm"), F.col("user_role").alias("p_role"), F.col("user_id_hash").alias("p_user"))
    rows = m.join(parent, F.col("reply_to_message_id") == F.col("p_id"), "left").join(duplicate_promotions(m), "message_id", "left")
    c = F.col
    label = seed_label(Message(c("text"), c("norm"), c("language"), c("user_role"), c("user_id_hash"), c("campaign_id"), c("p_norm"), c("p_role"), c("p_user"), c("prior_id").isNotNull()))
    out = rows.withColumn("label", label)
    behavior = c("label.behavior")
    evidence = F.when(behavior == "duplicate_promotion", F.array("prior_id", "message_id")).when(behavior.isin("question_answering", "peer_support"), F.array("p_id", "message_id")).otherwise(F.array("message_id"))
    return out.select("message_id", "community_id", "user_role", behavior.alias("behavior"), c("label.rule_id").alias("rule_id"), c("label.confidence").alias("confidence"), evidence.alias("evidence_ids"))


def feedback_counts(labels: DataFrame) -> DataFrame:
    """Messages of each kind of feedback, kinds without any too."""
    kinds = labels.sparkSession.createDataFrame([(x,) for x in FEEDBACK_LABELS], "behavior string")
    n = labels.where(F.col("behavior").isin(*FEEDBACK_LABELS)).groupBy("behavior").agg(F.count(F.lit(1)).alias("message_count"))
    return kinds.join(n, "behavior", "left").select("behavior", F.coalesce("message_count", F.lit(0)).alias("message_count"))
