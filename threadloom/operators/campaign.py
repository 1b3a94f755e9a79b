"""Claims of campaigns in what communities say: scopes, matches, judgments and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strength of a match by its status; all others count in full.
STRENGTH = {"partially_covered": 0.6, "uncertain": 0.5}


def scopes(campaigns: DataFrame, communities: DataFrame) -> DataFrame:
    """Every campaign with every community, silent ones too: two dimension tables, whose product is what is asked for."""
    return campaigns.select("campaign_id", "start_time", "end_time").crossJoin(communities.select("community_id").distinct()).withColumnRenamed("campaign_id", "scope_id")


def scoped_messages(messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """messages once for each campaign whose half-open window holds them, with scope_id, whatever their own campaign. Campaigns are few and Spark
    broadcasts them as far as their size allows."""
    window = campaigns.select(F.col("campaign_id").alias("scope_id"), "start_time", "end_time")
    return messages.join(window, (F.col("timestamp") >= F.col("start_time")) & (F.col("timestamp") < F.col("end_time"))).drop("start_time", "end_time")


def campaign_messages(messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """messages of a campaign's own within its window."""
    window = campaigns.select("campaign_id", "start_time", "end_time")
    return messages.join(window, "campaign_id").where((F.col("timestamp") >= F.col("start_time")) & (F.col("timestamp") < F.col("end_time"))).drop("start_time", "end_time")


def claim_matches(messages: DataFrame, patterns: DataFrame) -> DataFrame:
    """(campaign_id, claim_id, community_id, message_id, timestamp, status): of each message and claim, the statuses of the longest pattern found.

    messages has norm; patterns has campaign_id, claim_id, status, pattern (normalised). Only patterns of a message's campaign are tried.
    """
    hit = messages.select("campaign_id", "community_id", "message_id", "timestamp", "norm").join(patterns, "campaign_id").where(F.col("norm").contains(F.col("pattern")))
    best = hit.groupBy("campaign_id", "claim_id", "community_id", "message_id", "timestamp", "status").agg(F.max(F.char_length("pattern")).alias("length"))
    top = Window.partitionBy("message_id", "claim_id")
    return best.withColumn("top", F.max("length").over(top)).where(F.col("length") == F.col("top")).drop("length", "top")


def judgments(matches: DataFrame, claims: DataFrame, communities: DataFrame) -> DataFrame:
    """A row for every claim and community: its status, strength and number of supporting messages; conflicting statuses make it uncertain."""
    one = matches.groupBy("campaign_id", "claim_id", "community_id").agg(
        F.collect_set("status").alias("statuses"), F.count_distinct("message_id").alias("evidence_count"), F.max(F.when(F.col("status") == "partially_covered", 0.6).when(F.col("status") == "uncertain", 0.5).otherwise(1.0)).alias("strength")
    )
    every = claims.select("campaign_id", "claim_id").crossJoin(communities.select("community_id").distinct())
    out = every.join(one, ["campaign_id", "claim_id", "community_id"], "left")
    n = F.coalesce(F.size("statuses"), F.lit(0))
    status = F.when(F.col("statuses").isNull(), "not_covered").when(n == 1, F.col("statuses")[0]).otherwise("uncertain")
    strength = F.when(F.col("statuses").isNull(), 0.0).when(n > 1, 0.5).otherwise(F.col("strength"))
    return out.select("campaign_id", "claim_id", "community_id", status.alias("status"), strength.alias("match_strength"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def summary(judged: DataFrame) -> DataFrame:
    """Per campaign and community: coverage, completeness, warnings and drift."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    n = F.count(F.lit(1))
    return judged.groupBy("campaign_id", "community_id").agg(
        n.alias("total_claims"), is_("covered").alias("covered"), is_("partially_covered").alias("partially_covered"), is_("not_covered").alias("not_covered"), is_("uncertain").alias("uncertain"),
        ((is_("covered") + 0.5 * is_("partially_covered")) / n).alias("semantic_coverage"), (is_("covered") / n).alias("claim_completeness"),
        is_("contradicted", "incorrect", "uncertain").alias("warning_count"), is_("contradicted", "incorrect").alias("semantic_drift_count"),
    )
