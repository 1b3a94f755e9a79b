"""Column types of the logical tables; sources read with these, never by inference."""

from __future__ import annotations

MESSAGES = "message_id string, community_id string, language string, user_id_hash string, user_role string, timestamp timestamp, text string, reply_to_message_id string, campaign_id string"
CAMPAIGNS = "campaign_id string, campaign_name string, start_time timestamp, end_time timestamp, campaign_brief string"
CLAIMS = "claim_id string, campaign_id string, claim_text string, importance string"
OUTCOMES = "campaign_id string, community_id string, participants long, conversion double, new_users long, retention double, referrals long, synthetic boolean"
ANNOTATIONS = "annotation_id string, message_id string, scenario string, expected_behaviors array<string>, expected_claim_status string, expected_question_status string, notes string"
MANIFEST = "dataset_id string, schema_version string, synthetic boolean, seed long, message_count long, community_ids array<string>, languages array<string>, campaign_ids array<string>, scenarios map<string,string>, generated_at timestamp, generation_id string, artifact_checksums map<string,string>, source_format string, source_sha256 string, limitations array<string>"

ROLES = ("moderator", "user", "bot")
IMPORTANCE = ("critical", "high", "medium", "low")
USER_ID = r"^usr_[0-9a-f]+$"
LANGUAGE = r"^[a-z]{2,3}(-[a-z0-9]{2,8})*$"

# Kinds, channels and states of sources, and where the facts about them come from.
SOURCE_TYPES = (
    "whitepaper", "product_docs", "faq", "official_announcement", "official_blog", "release_notes", "changelog", "governance_proposal", "maintenance_notice", "campaign_rules", "community_rules",
    "manual_official_note",
)
SOURCE_CHANNELS = ("docs", "website", "medium", "x", "telegram_announcement", "github", "governance", "manual")
SOURCE_STATUSES = ("current", "superseded", "expired", "historical", "draft", "unknown")
PROVENANCES = ("source-provided", "human-confirmed", "system-derived", "ai-inferred")
CRITICAL_METADATA = ("source_type", "authority_level", "official_status", "published_at", "validity")
