"""The driver's tables as messages, campaigns, claims and other logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "official campaign update", "register now please", "this looks like a scam", "the guide is unclear", "love this update", "please add dark mode", "i joined today", "welcome new members",
    "we will buy later", "good morning", "the wallet is broken", "never a scam here", "launches september 20", "100 tokens", "50 tokens", "see https://a.example", "actually that was corrected", "project roadmap talk",
    "feedback is invited", "weather today is fine",
)

#: Messages from turns: a role's user, uneven times, a question mark on some users' turns, some phrases, replies to the previous or first turn.
MESSAGES_SQL = """
SELECT concat('c', conv_id, '_', turn) AS message_id, concat('g', conv_id % 4) AS community_id, CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'es' ELSE 'en-us' END AS language,
       CASE role WHEN 'user' THEN concat('usr_', (conv_id * 3 + turn % 4) % 29) WHEN 'assistant' THEN concat('usr_a', conv_id % 5) ELSE 'usr_b0' END AS user_id_hash,
       CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'moderator' ELSE 'bot' END AS user_role,
       timestamp '2024-01-01 00:00:00' + {second} AS timestamp,
       concat(CASE WHEN role = 'assistant' AND conv_id % 6 = 0 THEN 'our news of today' ELSE text END, CASE WHEN conv_id % 6 > 0 AND (conv_id + turn) % 3 = 0 THEN concat(' ', {phrase}) ELSE '' END, CASE WHEN role = 'user' AND (conv_id + turn) % 2 = 0 THEN '?' ELSE '' END) AS text,
       CASE WHEN first_turn = turn THEN NULL WHEN (conv_id + turn) % 3 = 1 THEN concat('c', conv_id, '_', first_turn) ELSE concat('c', conv_id, '_', previous) END AS reply_to_message_id,
       CASE conv_id % 5 WHEN 0 THEN 'camp_a' WHEN 1 THEN 'camp_b' END AS campaign_id, conv_id, turn
FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM {source})
"""

CAMPAIGNS = (("camp_a", "2024-01-01 00:00:00", "2024-01-03 12:00:00"), ("camp_b", "2024-01-02 16:00:00", "2024-03-25 00:00:00"))
# claim, campaign, status, pattern
PATTERNS = (
    ("stake_reward", "camp_a", "covered", "100 tokens"), ("stake_reward", "camp_a", "incorrect", "50 tokens"), ("launch_date", "camp_a", "covered", "launches september 20"), ("stake_deadline", "camp_a", "covered", "before friday"),
    ("launch_feedback", "camp_b", "covered", "feedback is invited"), ("launch_feedback", "camp_b", "partially_covered", "official campaign"), ("referral_count", "camp_b", "covered", "register now"), ("referral_count", "camp_b", "contradicted", "never a scam"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = "element_at(array(" + ", ".join(f"'{p}'" for p in PHRASES) + f"), cast((conv_id * 7 + turn) % {len(PHRASES)} as int) + 1)"
    second = "make_dt_interval(0, 0, 0, conv_id * 3600 + turn * 97 + (conv_id * 7 + turn * 13) % 60)"
    sql = MESSAGES_SQL.replace("{phrase}", phrase).replace("{second}", second)
    return spark.sql(sql, source=table(spark, sf_dir, "conversations"))


def campaigns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAMPAIGNS), "campaign_id string, s string, e string").select("campaign_id", F.to_timestamp("s").alias("start_time"), F.to_timestamp("e").alias("end_time"))


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PATTERNS), "claim_id string, campaign_id string, status string, pattern string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages without replies: a source is a community."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("message_id"), F.col("source").alias("community_id"), F.col("lang").alias("language"), F.concat(F.lit("usr_"), F.col("doc_id") % 37).alias("user_id_hash"), "text", "doc_id")
