"""Metrics of every scope (campaign and community) in one plan, wide and long, and the sections of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.behavior import FEEDBACK_LABELS
from ..functions.text import language_scope, mentions_project
from ..operators.activation import activation
from ..operators.behavior import feedback_counts, seed_behaviors
from ..operators.campaign import campaign_messages, claim_matches, judgments, scoped_messages, scopes, summary
from ..operators.evidence import referring, source_evidence, union_of_evidence
from ..operators.hygiene import content_ratios, supporting_messages
from ..operators.threads import episodes, question_support, with_question

METRICS = (
    "campaign_discussion_share", "community_response_latency", "conversation_propagation_depth", "meaningful_interaction_ratio", "organic_project_mention_rate", "peer_support_ratio",
    "semantic_campaign_coverage", "semantic_drift_rate", "unanswered_question_rate", "user_to_user_interaction_ratio",
)


def in_scopes(messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """messages once for each scope, as messages of their own: ids and replies are the scope's, and community_id names scope and community. A reply whose parent is outside counts as
    a root. All analyzers then take every scope at once, without a loop."""
    s = scoped_messages(messages, campaigns)
    own = lambda c: F.concat_ws("|", "scope_id", c)
    return s.withColumns({"message_id": own("message_id"), "reply_to_message_id": F.when(F.col("reply_to_message_id").isNotNull(), own("reply_to_message_id")), "in_community": F.col("community_id"), "community_id": own("community_id")})


def scope_metrics(messages: DataFrame, campaigns: DataFrame, patterns: DataFrame) -> DataFrame:
    """A row for each campaign and community, silent ones too: the ten metrics, null where a denominator is 0 (claims always have one)."""
    asked = with_question(messages)
    s = in_scopes(asked, campaigns)
    every = scopes(campaigns, messages).select("scope_id", F.col("community_id").alias("in_community"), F.concat_ws("|", "scope_id", "community_id").alias("community_id"))
    user = F.col("user_role") == "user"
    free = user & F.col("campaign_id").isNull()
    counts = s.groupBy("community_id").agg(F.count_if(user).alias("users"), F.count_if(user & (F.col("campaign_id") == F.col("scope_id"))).alias("campaign_users"), F.count_if(free).alias("free_users"), F.count_if(free & mentions_project(F.col("norm"), F.col("language"))).alias("mentions"))
    act = activation(s).select("community_id", "user_to_user_interaction_ratio", "meaningful_interaction_ratio", "response_latency_seconds")
    deep = episodes(s).groupBy("community_id").agg(F.avg("conversation_depth").alias("depth"))
    asks = question_support(s)
    claims = patterns.select("campaign_id", "claim_id").distinct()
    judged = summary(judgments(claim_matches(campaign_messages(asked, campaigns), patterns), claims, messages))
    cov = judged.select(F.concat_ws("|", "campaign_id", "community_id").alias("community_id"), "semantic_coverage", (F.col("semantic_drift_count") / F.col("total_claims")).alias("drift"))
    out = every
    for part in (counts, act, deep, asks, cov):
        out = out.join(part, "community_id", "left")
    ratio = lambda a, b: F.when(F.coalesce(b, F.lit(0)) != 0, a / b)
    c = F.col
    return out.select(
        "scope_id", c("in_community").alias("community_id"), ratio(c("campaign_users"), c("users")).alias("campaign_discussion_share"), c("response_latency_seconds").alias("community_response_latency"), c("depth").alias("conversation_propagation_depth"),
        F.when(c("users") > 0, c("meaningful_interaction_ratio")).alias("meaningful_interaction_ratio"), ratio(c("mentions"), c("free_users")).alias("organic_project_mention_rate"), ratio(c("peer_first"), c("answered")).alias("peer_support_ratio"),
        c("semantic_coverage").alias("semantic_campaign_coverage"), c("drift").alias("semantic_drift_rate"), ratio(c("unanswered"), c("user_questions")).alias("unanswered_question_rate"), F.when(c("users") > 0, c("user_to_user_interaction_ratio")).alias("user_to_user_interaction_ratio"),
    )


def long_form(wide: DataFrame) -> DataFrame:
    """A row for each scope and metric, with its reason."""
    out = wide.unpivot(["scope_id", "community_id"], list(METRICS), "metric_name", "metric_value")
    return out.withColumn("diagnostic_reason", F.when(F.col("metric_value").isNull(), "zero_denominator").otherwise("observed"))


def languages(messages: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per scope: language_scope, languages in order, and how many messages each has; a silent scope has none."""
    n = scoped_messages(messages, campaigns).groupBy("scope_id", "community_id", "language").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("scope_id", "community_id").agg(F.array_sort(F.collect_list(F.struct("language", "n"))).alias("d"))
    every = scopes(campaigns, messages).select("scope_id", "community_id").join(per, ["scope_id", "community_id"], "left")
    names = F.coalesce(F.transform("d", lambda x: x["language"]), F.array().cast("array<string>"))
    return every.select("scope_id", "community_id", language_scope(names).alias("language_scope"), names.alias("languages"), F.map_from_entries(F.coalesce("d", F.array().cast("array<struct<language: string, n: bigint>>"))).alias("language_distribution"))


def hygiene_section(messages: DataFrame) -> DataFrame:
    """Rates of each community, and the ids of the evidence that they rest on."""
    found = referring(supporting_messages(messages).groupBy("community_id").agg(F.collect_set("message_id").alias("m")), "m")
    return content_ratios(messages).join(found, "community_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def feedback_section(labels: DataFrame) -> DataFrame:
    """Messages of each kind of feedback, whether any was observed, and the ids of their evidence. labels comes from seed_behaviors()."""
    told = labels.withColumnRenamed("evidence_ids", "messages")
    union = union_of_evidence(referring(told.where(F.col("behavior").isin(*FEEDBACK_LABELS)), "messages"), ["behavior"])
    out = feedback_counts(labels).join(union, "behavior", "left")
    return out.select("behavior", "message_count", F.when(F.col("message_count") > 0, "Observed").otherwise("Not observed in this dataset").alias("observation_status"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


def report(messages: DataFrame, campaigns: DataFrame, patterns: DataFrame) -> dict[str, DataFrame]:
    """The sections: hygiene, activation, episodes, behavior, feedback, campaign summary, metrics with the languages of their scopes, and evidence, each in a fixed order."""
    asked = with_question(messages)
    labels = seed_behaviors(asked)
    claims = patterns.select("campaign_id", "claim_id").distinct()
    wide = scope_metrics(messages, campaigns, patterns)
    hygiene, behavior = hygiene_section(messages), referring(labels.withColumnRenamed("evidence_ids", "messages"), "messages")
    sections = {
        "hygiene": hygiene, "activation": activation(asked), "episodes": episodes(asked), "behavior": behavior, "feedback": feedback_section(labels),
        "campaign": summary(judgments(claim_matches(campaign_messages(asked, campaigns), patterns), claims, messages)),
        "metrics": long_form(wide).join(languages(messages, campaigns).drop("language_distribution"), ["scope_id", "community_id"]),
    }
    referred = hygiene.select(F.explode("evidence_ids").alias("evidence_id")).union(behavior.select(F.explode("evidence_ids").alias("evidence_id"))).distinct()
    sections["evidence"] = source_evidence(messages.withColumn("analysis", F.lit(None).cast("string")), "analysis").join(referred, "evidence_id", "left_semi")
    order = {"hygiene": ["community_id"], "activation": ["community_id"], "episodes": ["root_id"], "behavior": ["message_id"], "feedback": ["behavior"], "campaign": ["campaign_id", "community_id"], "metrics": ["scope_id", "community_id", "metric_name"], "evidence": ["evidence_id"]}
    return {k: v.orderBy(*order[k]) for k, v in sections.items()}
