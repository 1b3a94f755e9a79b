"""Declared constraints as queries: each gives a row (rule, key) for every violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CRITICAL_METADATA, IMPORTANCE, LANGUAGE, PROVENANCES, ROLES, SOURCE_CHANNELS, SOURCE_STATUSES, SOURCE_TYPES, USER_ID
from .threads import reply_edges, roots


def _rows(df: DataFrame, rule: str, key: str | Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return _rows(df.groupBy(*keys).count().where("count > 1"), rule, F.concat_ws("|", *keys))


def references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    ids = parent.select(F.col(parent_key).alias(key)).distinct()
    return _rows(child.where(F.col(key).isNotNull()).join(ids, key, "left_anti"), rule, key)


def blank(df: DataFrame, columns: list[str], id_: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [_rows(df.where(F.col(c).isNull() | (F.trim(c) == "")), f"blank_{c}", id_) for c in columns])


def message_rules(messages: DataFrame) -> DataFrame:
    """Violations of a message table: ids, formats, and replies that are missing, their own parent, of another community or campaign, earlier than
    their parent, or in a cycle."""
    m = messages
    e = reply_edges(m)
    checks = [
        unique(m, ["message_id"], "duplicate_message_id"), blank(m, ["message_id", "community_id", "text"], "message_id"),
        _rows(m.where(~F.col("user_role").isin(*ROLES)), "unknown_role", "message_id"), _rows(m.where(~F.col("user_id_hash").rlike(USER_ID)), "malformed_user_id", "message_id"),
        _rows(m.where(~F.col("language").rlike(LANGUAGE)), "malformed_language", "message_id"), references(m, "reply_to_message_id", m, "message_id", "missing_parent"),
        _rows(m.where(F.col("message_id") == F.col("reply_to_message_id")), "self_reply", "message_id"), _rows(e.where(F.col("community_id") != F.col("p_community_id")), "cross_community_reply", "message_id"),
        _rows(e.where(F.col("campaign_id") != F.col("p_campaign_id")), "cross_campaign_reply", "message_id"), _rows(e.where(F.col("timestamp") < F.col("p_timestamp")), "reply_before_parent", "message_id"),
        _rows(m.join(roots(m), "message_id", "left_anti"), "cycle", "message_id"),
    ]
    return reduce(DataFrame.unionByName, checks)


def campaign_rules(campaigns: DataFrame, claims: DataFrame, outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """Violations of the campaign tables and their references."""
    ratio = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    checks = [
        unique(campaigns, ["campaign_id"], "duplicate_campaign_id"), unique(claims, ["claim_id"], "duplicate_claim_id"), unique(outcomes, ["community_id", "campaign_id"], "duplicate_outcome"),
        _rows(campaigns.where(F.col("end_time") <= F.col("start_time")), "empty_campaign_window", "campaign_id"), _rows(claims.where(~F.col("importance").isin(*IMPORTANCE)), "unknown_importance", "claim_id"),
        references(claims, "campaign_id", campaigns, "campaign_id", "claim_without_campaign"), references(outcomes, "campaign_id", campaigns, "campaign_id", "outcome_without_campaign"),
        references(messages, "campaign_id", campaigns, "campaign_id", "message_without_campaign"), _rows(outcomes.where(ratio("conversion") | ratio("retention")), "ratio_out_of_range", F.concat_ws("|", "community_id", "campaign_id")),
    ]
    return reduce(DataFrame.unionByName, checks)


def source_rules(sources: DataFrame) -> DataFrame:
    """Violations of sources as they are handed in: kinds that aren't known, blank texts, addresses, times, and where the critical facts come from.

    metadata_provenance is a map from a fact's name to its origin."""
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    blank_ = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    url, origin = F.col("canonical_url"), F.col("metadata_provenance")
    checks = [
        (known("source_type", SOURCE_TYPES), "unsupported_source_type"), (known("source_channel", SOURCE_CHANNELS), "unsupported_source_channel"), (known("status", SOURCE_STATUSES), "unsupported_status"),
        (blank_("title") | blank_("content"), "blank_title_or_content"), ((F.col("source_channel") != "manual") & blank_("canonical_url"), "missing_canonical_url"), (~blank_("canonical_url") & ~url.rlike(r"(?i)^https?:"), "unsupported_canonical_url"),
        (F.col("effective_until") <= F.col("effective_from"), "empty_validity"), (F.size(F.array_except(F.array(*map(F.lit, CRITICAL_METADATA)), F.map_keys(origin))) != 0, "missing_provenance"),
        (F.exists(F.map_values(origin), lambda v: ~F.coalesce(v.isin(*PROVENANCES), F.lit(False))), "unsupported_provenance"),
        (F.exists(F.array(*[origin[k] for k in CRITICAL_METADATA]), lambda v: F.coalesce(v == "ai-inferred", F.lit(False))), "inferred_critical_metadata"),
    ]
    found = sources.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in checks]))))
    return found.select("rule", F.col("source_id").cast("string").alias("key"))


def set_differences(observed: DataFrame, declared: DataFrame, column: str, rule: str) -> DataFrame:
    """Values of one side that the other lacks."""
    a, b = observed.select(column).distinct(), declared.select(column).distinct()
    return _rows(a.exceptAll(b), f"{rule}_undeclared", column).unionByName(_rows(b.exceptAll(a), f"{rule}_unobserved", column))
