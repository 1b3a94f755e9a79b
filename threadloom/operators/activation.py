"""Participation of users and moderators in a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_meaningful
from .threads import classified_edges, with_question


def first_replies(messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each user's message with a moderator's direct reply: the first reply, by time and id, and its latency in seconds."""
    e = classified_edges(messages).where(F.col("edge") == "user_to_moderator")
    first = e.groupBy(*by, "p_message_id", "p_community_id", "p_timestamp").agg(F.min(F.struct("timestamp", "message_id")).alias("r"))
    return first.select(*by, F.col("p_message_id").alias("message_id"), F.col("p_community_id").alias("community_id"), F.col("r.message_id").alias("reply_id"), (F.timestamp_diff("MICROSECOND", F.col("p_timestamp"), F.col("r.timestamp")) / 1e6).alias("latency_seconds"))


def _ratio(a: Column, b: Column) -> Column:
    """0 without a denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def activation(messages: DataFrame) -> DataFrame:
    """Per community: users, messages by role, and ratios of interaction; a ratio without a denominator is 0, a latency is null."""
    m = messages if "asks" in messages.columns else with_question(messages)
    user = F.col("user_role") == "user"
    base = m.groupBy("community_id").agg(
        F.count_distinct(F.when(user, F.col("user_id_hash"))).alias("unique_engaged_users"), F.count_if(user).alias("user_messages"), F.count_if(F.col("user_role") == "moderator").alias("moderator_messages"),
        F.count_if(user & is_meaningful(F.col("norm"), F.col("language"))).alias("meaningful"), F.min("timestamp").alias("observed_start"), F.max("timestamp").alias("observed_end"),
    )
    e = classified_edges(m.drop("text", "norm"))
    peer = (F.col("edge") == "user_to_user") & F.col("p_asks") & ~F.col("asks")
    edges = e.groupBy("community_id").agg(F.count_if(F.col("edge") == "self").alias("self_reply_count"), F.count_if(F.col("edge") == "user_to_user").alias("user_edges"), F.count_if(peer).alias("peer_edges"))
    late = first_replies(m.drop("text", "norm")).groupBy("community_id").agg(F.avg("latency_seconds").alias("response_latency_seconds"), F.count(F.lit(1)).alias("responses"))
    out = base.join(edges, "community_id", "left").join(late, "community_id", "left").fillna(0, ["self_reply_count", "user_edges", "peer_edges", "responses"])
    return out.select("community_id", "unique_engaged_users", "user_messages", "moderator_messages", "self_reply_count", _ratio(F.col("user_edges"), F.col("user_messages")).alias("user_to_user_interaction_ratio"), _ratio(F.col("peer_edges"), F.col("user_edges")).alias("peer_support_edge_ratio"),
                      _ratio(F.col("meaningful"), F.col("user_messages")).alias("meaningful_interaction_ratio"), "response_latency_seconds", "responses", "observed_start", "observed_end")
