"""Behavior labels by ordered rules over one message and its parent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, contains_any, contains_undenied, is_language_filler, is_question, url_count

# Phrases by label, and the rule that each names.
MODERATOR_PHRASES = (
    ("misinformation_correction", "correction_phrase_v1", ("correction", "corrected", "actually", "not 50", "更正", "纠正", "تصحيح")),
    ("translation", "translation_marker_v1", ("translation:", "translated:", "翻译：", "翻译:", "الترجمة:")),
    ("user_onboarding", "onboarding_phrase_v1", ("welcome new", "new members", "onboarding guide", "欢迎新成员", "新手指南")),
    ("conflict_handling", "conflict_phrase_v1", ("resolve this dispute", "de-escalate", "conflict", "解决争议", "化解冲突")),
    ("sentiment_soothing", "soothing_phrase_v1", ("understand your concern", "sorry this is frustrating", "we hear your concern", "理解你的担忧", "抱歉让你困扰")),
    ("CTA", "call_to_action_phrase_v1", ("join the campaign", "register now", "click the link", "stake now", "立即参加", "立即注册")),
    ("product_explanation", "product_explanation_phrase_v1", ("product feature", "feature works", "how it works", "connect your wallet", "产品功能", "使用方法")),
)
CAMPAIGN_FACTS = ("official campaign", "campaign update", "deadline", "reward", "活动公告", "截止", "奖励")
SOCIAL = ("good morning", "good afternoon", "how is everyone", "hope everyone", "大家好")
SPAM = ("buy now", "guaranteed profit", "free airdrop now")
PRODUCT = ("product", "wallet", "feature", "how does", "产品", "钱包", "功能")
CAMPAIGN = ("campaign", "deadline", "reward", "活动", "截止", "奖励")
DOUBT = (("scam", "rug pull", "dead project"), ("骗局", "跑路"))
REQUEST = ("please add", "wish you would add", "can you add", "功能建议", "请增加")
COMPLAINT = (("broken", "frustrating", "terrible", "disappointed", "complaint"), ("糟糕", "失望", "投诉"))
NEGATIVE = (("feedback is negative", "guide is unclear", "unclear and confusing", "negative feedback"), ("not useful", "负面反馈", "不清楚", "غير واضح", "لم نحصل على إجابة واضحة"))
POSITIVE = ("feedback is positive", "love this update", "clear and useful", "guide is useful", "positive feedback", "正面反馈", "清楚有用")
RESPONSE = ("done, i registered", "i registered", "i joined", "i staked", "已报名", "已参加")
OFF_TOPIC = ("off topic", "football match", "weather today", "题外话", "足球比赛")
EXTERNAL = ("external article", "external source", "外部文章", "新闻链接")
INTENT = ("plan to use", "want to use", "will try", "intend to use", "intend to purchase", "plan to purchase", "want to buy", "will buy", "准备使用", "打算使用", "准备购买")
PROJECT = ("project roadmap", "token utility", "project governance", "项目路线图", "代币用途")
FRAUD = r"(?U)(?<!\w)(?:this|it|the project)\s+(?:is|looks like)\s+(?:a\s+)?fraud(?!\w)"
FEEDBACK_LABELS = ("FUD", "complaint", "feature_request", "negative_feedback", "positive_feedback")

# Strength of the evidence of a rule's kind.
LEXICAL, RELATIONAL, DUPLICATE, FILLER = 0.65, 0.8, 0.85, 0.55


@dataclass(frozen=True)
class Message:
    """Columns of a message and, with p_ before, of its parent (null without one)."""

    text: Column
    norm: Column
    language: Column
    role: Column
    user: Column
    campaign: Column
    p_norm: Column
    p_role: Column
    p_user: Column
    duplicate: Column


def _first(rules: list[tuple[Column, str, str, float]], otherwise: tuple[str, str, float]) -> Column:
    one = lambda label, rule, strength: F.struct(F.lit(label).alias("behavior"), F.lit(rule).alias("rule_id"), F.lit(float(strength)).alias("confidence"))
    out = F.when(rules[0][0], one(*rules[0][1:]))
    for condition, *rest in rules[1:]:
        out = out.when(condition, one(*rest))
    return out.otherwise(one(*otherwise))


_NONE = ("unclassified", "no_seed_rule_match_v1", 0.0)


def moderator_label(m: Message) -> Column:
    asks = is_question(m.norm)
    answers = (m.p_role == "user") & is_question(m.p_norm) & (m.user != m.p_user) & ~asks
    rules = [
        (m.duplicate, "duplicate_promotion", "same_actor_campaign_window_exact_text_v1", DUPLICATE),
        (is_language_filler(m.norm, m.language), "filler", "language_filler_v1", FILLER),
        ((url_count(m.text) >= 2) | contains_any(m.norm, SPAM), "spam", "repeated_link_or_spam_phrase_v1", LEXICAL),
        (answers, "question_answering", "moderator_reply_to_question_v1", RELATIONAL),
        (m.p_role.isNull() & asks, "conversation_initiation", "moderator_root_question_v1", LEXICAL),
        *[(contains_any(m.norm, terms), label, rule, LEXICAL) for label, rule, terms in MODERATOR_PHRASES],
        (m.campaign.isNotNull() & contains_any(m.norm, CAMPAIGN_FACTS), "campaign_propagation", "campaign_fact_phrase_v1", LEXICAL),
        (contains_any(m.norm, SOCIAL), "normal_chat", "moderator_social_phrase_v1", LEXICAL),
    ]
    return _first(rules, _NONE)


def user_label(m: Message) -> Column:
    asks = is_question(m.norm)
    peer = (m.p_role == "user") & (m.user != m.p_user) & ~asks
    rules = [
        (asks & contains_any(m.norm, PRODUCT), "product_question", "product_question_phrase_v1", LEXICAL),
        (asks & (m.campaign.isNotNull() | contains_any(m.norm, CAMPAIGN)), "campaign_question", "campaign_question_phrase_v1", LEXICAL),
        (any_of([contains_undenied(m.norm, DOUBT[0]), contains_any(m.norm, DOUBT[1]), m.norm.rlike(FRAUD)]), "FUD", "fud_phrase_v1", LEXICAL),
        (m.norm.rlike(r"(?U)(?<!\w)feature request\s*:") | contains_any(m.norm, REQUEST), "feature_request", "feature_request_phrase_v1", LEXICAL),
        (contains_undenied(m.norm, COMPLAINT[0]) | contains_any(m.norm, COMPLAINT[1]), "complaint", "complaint_phrase_v1", LEXICAL),
        (contains_undenied(m.norm, NEGATIVE[0]) | contains_any(m.norm, NEGATIVE[1]), "negative_feedback", "negative_feedback_phrase_v1", LEXICAL),
        (contains_any(m.norm, POSITIVE), "positive_feedback", "positive_feedback_phrase_v1", LEXICAL),
        (peer, "peer_support", "user_reply_to_peer_v1", RELATIONAL),
        (contains_any(m.norm, RESPONSE), "CTA_response", "cta_response_phrase_v1", LEXICAL),
        (contains_any(m.norm, OFF_TOPIC), "off_topic", "off_topic_phrase_v1", LEXICAL),
        ((url_count(m.text) >= 1) | contains_any(m.norm, EXTERNAL), "external_information_sharing", "external_source_or_url_v1", LEXICAL),
        (contains_any(m.norm, INTENT), "purchase_or_usage_intent", "purchase_or_usage_intent_phrase_v1", LEXICAL),
        (contains_any(m.norm, PROJECT), "project_discussion", "project_discussion_phrase_v1", LEXICAL),
    ]
    return _first(rules, _NONE)


def seed_label(m: Message) -> Column:
    """struct(behavior, rule_id, confidence) of a message; bots are not classified."""
    bot = F.struct(F.lit("unclassified").alias("behavior"), F.lit("bot_not_classified_v1").alias("rule_id"), F.lit(0.0).alias("confidence"))
    return F.when(m.role == "moderator", moderator_label(m)).when(m.role == "user", user_label(m)).otherwise(bot)
