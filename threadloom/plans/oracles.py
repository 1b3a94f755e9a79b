"""SQL for DuckDB that gives the rows of the queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..functions import behavior as b
from ..functions import text as t
from ..sources.conversations import CAMPAIGNS, MESSAGES_SQL, PATTERNS, PHRASES


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def values(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else quote(x) if isinstance(x, str) else str(x) for x in r) + ')' for r in rows)}) AS v({names}))"


def any_of(conditions: list[str]) -> str:
    return "(" + " OR ".join(conditions or ["FALSE"]) + ")"


def asks(n: str) -> str:
    return any_of([f"contains({n}, {quote(x)})" for x in ("?", *t.QUESTION_PHRASES)] + [f"starts_with({n}, {quote(x)})" for x in t.QUESTION_PREFIXES] + [f"ends_with({n}, {quote(x)})" for x in t.QUESTION_SUFFIXES])


def has(n: str, terms) -> str:
    word = "[\\pL\\pN_]"
    import re

    one = lambda x: f"regexp_matches({n}, {quote('(^|[^\\pL\\pN_])' + re.escape(x) + '($|[^\\pL\\pN_])')})" if re.search("[a-z]", x) else f"contains({n}, {quote(x)})"
    assert word
    return any_of([one(t.normal_form(x)) for x in terms])


def undenied(n: str, terms) -> str:
    """Without look-behind: what denies is taken out with the term that it goes before, then the term is looked for."""
    import re

    out = []
    for x in terms:
        x = re.escape(x)
        bare = f"regexp_replace({n}, {quote('\\b(?:not|never|no\\s+longer|far\\s+from)\\s+(?:\\w+\\s+){0,2}' + x + '\\b')}, ' ', 'g')"
        out.append(f"regexp_matches({bare}, {quote('(^|[^\\pL\\pN_])' + x + '($|[^\\pL\\pN_])')})")
    return any_of(out)


_PHRASE = "(" + "[" + ", ".join(map(quote, PHRASES)) + f"])[((conv_id * 7 + turn) % {len(PHRASES)})::INTEGER + 1]"
_RAW = MESSAGES_SQL.replace("{phrase}", _PHRASE).replace("{second}", "to_seconds(conv_id * 3600 + turn * 97 + (conv_id * 7 + turn * 13) % 60)").replace("{source}", "conversations").replace("AS timestamp,", "AS ts,")

_MAIN = "lower(split_part(language, '-', 1))"
_FILLER = any_of([f"norm IN ({', '.join(map(quote, t.GLOBAL_FILLERS))})", *[f"({_MAIN} = {quote(k)} AND norm IN ({', '.join(map(quote, v))}))" for k, v in t.LANGUAGE_FILLERS.items()]])
_MEANINGFUL = f"(NOT {_FILLER} AND length(norm) >= CASE {_MAIN} WHEN 'zh' THEN 2 ELSE 4 END)"
_MENTION = any_of([f"(split_part(language, '-', 1) = {quote(k)} AND {has('norm', v)})" for k, v in t.PROJECT_TERMS.items()])
_CAMP = values(CAMPAIGNS, "campaign_id, s, e")

#: Common tables: messages, edges, threads from the roots down, questions and their candidate answers.
BASE = f"""
WITH RECURSIVE raw AS ({_RAW}), n AS (SELECT *, {norm('text')} AS norm FROM raw), m AS (SELECT *, {asks('norm')} AS asks, {_MEANINGFUL} AS meaningful, {_MENTION} AS mention FROM n),
camp AS (SELECT campaign_id, s::TIMESTAMP AS s, e::TIMESTAMP AS e FROM {_CAMP}),
sc AS (SELECT c.campaign_id AS scope, m.* REPLACE (c.campaign_id || '|' || m.message_id AS message_id, c.campaign_id || '|' || m.reply_to_message_id AS reply_to_message_id), m.message_id AS plain FROM m JOIN camp c ON ts >= s AND ts < e)
"""


def base(source: str = "m", key: str = "community_id") -> str:
    """Edges (e), threads (th), candidate answers (ca) over a table of messages."""
    return BASE + f""",
x AS (SELECT *, {key} AS grp FROM {source}),
e AS (SELECT c.*, p.message_id AS p_id, p.user_role AS p_role, p.user_id_hash AS p_user, p.ts AS p_ts, p.asks AS p_asks,
      CASE WHEN c.user_role = 'user' AND p.user_role = 'user' AND c.user_id_hash = p.user_id_hash THEN 'self' WHEN c.user_role = 'user' AND p.user_role = 'user' THEN 'user_to_user'
           WHEN p.user_role = 'user' AND c.user_role = 'moderator' THEN 'user_to_moderator' ELSE 'other' END AS edge FROM x c JOIN x p ON c.reply_to_message_id = p.message_id),
th AS (SELECT message_id, message_id AS root_id, 1 AS depth FROM x WHERE reply_to_message_id IS NULL OR reply_to_message_id NOT IN (SELECT message_id FROM x)
       UNION ALL SELECT x.message_id, th.root_id, th.depth + 1 FROM th JOIN x ON x.reply_to_message_id = th.message_id),
wk AS (SELECT message_id AS q, user_id_hash AS asker, message_id AS node, TRUE AS through FROM x WHERE asks
       UNION ALL SELECT wk.q, wk.asker, x.message_id, x.asks OR x.user_id_hash = wk.asker FROM wk JOIN x ON x.reply_to_message_id = wk.node WHERE wk.through AND x.user_role <> 'bot'),
ca AS (SELECT q AS question_id, node AS answer_id FROM wk WHERE NOT through)
"""


_LATE = "late AS (SELECT p_id, grp, p_ts, min(ts) AS r_ts FROM e WHERE edge = 'user_to_moderator' GROUP BY ALL)"
_FIRST = "fa AS (SELECT ca.question_id, min({'t': a.ts, 'id': a.message_id, 'role': a.user_role, 'u': a.user_id_hash}) AS f FROM ca JOIN x a ON a.message_id = ca.answer_id GROUP BY 1)"
_QS = f"{_FIRST}, qs AS (SELECT grp, count(*) AS user_questions, count(*) FILTER (f IS NULL) AS unanswered, count(*) FILTER (f IS NOT NULL) AS answered, count(*) FILTER (f.role = 'user' AND f.u <> user_id_hash) AS peer_first FROM x LEFT JOIN fa ON question_id = message_id WHERE asks AND user_role = 'user' GROUP BY 1)"

POSTS = f"WITH p AS (SELECT 'd' || doc_id AS message_id, source AS community_id, 'usr_' || (doc_id % 37) AS user_id_hash, text, {norm('text')} AS norm, doc_id FROM documents)"

_PAT = values(PATTERNS, "claim_id, campaign_id, status, pattern")
_JUDGED = f"""pat AS (SELECT * FROM {_PAT}), cm AS (SELECT m.* FROM m JOIN camp c USING (campaign_id) WHERE ts >= s AND ts < e),
hit AS (SELECT cm.campaign_id, claim_id, community_id, message_id, status, max(length(pattern)) AS len FROM cm JOIN pat USING (campaign_id) WHERE contains(norm, pattern) GROUP BY ALL),
best AS (SELECT * FROM hit QUALIFY len = max(len) OVER (PARTITION BY message_id, claim_id)),
one AS (SELECT campaign_id, claim_id, community_id, count(DISTINCT status) AS k, min(status) AS st, count(DISTINCT message_id) AS evidence_count, max(CASE status WHEN 'partially_covered' THEN 0.6 WHEN 'uncertain' THEN 0.5 ELSE 1.0 END) AS w FROM best GROUP BY ALL),
judged AS (SELECT c.campaign_id, c.claim_id, g.community_id, CASE WHEN k IS NULL THEN 'not_covered' WHEN k = 1 THEN st ELSE 'uncertain' END AS status,
           (CASE WHEN k IS NULL THEN 0.0 WHEN k > 1 THEN 0.5 ELSE w END)::DOUBLE AS match_strength, coalesce(evidence_count, 0) AS evidence_count
           FROM (SELECT DISTINCT campaign_id, claim_id FROM pat) c CROSS JOIN (SELECT DISTINCT community_id FROM m) g LEFT JOIN one USING (campaign_id, claim_id, community_id)),
summ AS (SELECT campaign_id, community_id, count(*) AS total_claims, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'partially_covered') AS partially_covered, count(*) FILTER (status = 'not_covered') AS not_covered,
         count(*) FILTER (status = 'uncertain') AS uncertain, count(*) FILTER (status IN ('contradicted', 'incorrect', 'uncertain')) AS warning_count, count(*) FILTER (status IN ('contradicted', 'incorrect')) AS semantic_drift_count FROM judged GROUP BY ALL)"""


def _label_case(rows: list[tuple[str, str]], otherwise: str = "unclassified") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quote(x)}" for c, x in rows) + f" ELSE {quote(otherwise)} END"


def _labels() -> str:
    n, urls = "x.norm", "len(regexp_extract_all(x.text, '(?i)https?://\\S+'))"
    ask = "x.asks"
    mod = [
        ("d.message_id IS NOT NULL", "duplicate_promotion"), (_FILLER.replace("norm", "x.norm").replace("lower(split_part(language", "lower(split_part(x.language"), "filler"), (f"({urls} >= 2 OR {has(n, b.SPAM)})", "spam"),
        (f"(p.user_role = 'user' AND p.asks AND x.user_id_hash <> p.user_id_hash AND NOT {ask})", "question_answering"), (f"(p.message_id IS NULL AND {ask})", "conversation_initiation"),
        *[(has(n, terms), label) for label, _, terms in b.MODERATOR_PHRASES], (f"(x.campaign_id IS NOT NULL AND {has(n, b.CAMPAIGN_FACTS)})", "campaign_propagation"), (has(n, b.SOCIAL), "normal_chat"),
    ]
    fraud = "'(^|[^\\pL\\pN_])(?:this|it|the project)\\s+(?:is|looks like)\\s+(?:a\\s+)?fraud($|[^\\pL\\pN_])'"
    usr = [
        (f"({ask} AND {has(n, b.PRODUCT)})", "product_question"), (f"({ask} AND (x.campaign_id IS NOT NULL OR {has(n, b.CAMPAIGN)}))", "campaign_question"),
        (f"({undenied(n, b.DOUBT[0])} OR {has(n, b.DOUBT[1])} OR regexp_matches({n}, {fraud}))", "FUD"), (f"(regexp_matches({n}, '(^|[^\\pL\\pN_])feature request\\s*:') OR {has(n, b.REQUEST)})", "feature_request"),
        (f"({undenied(n, b.COMPLAINT[0])} OR {has(n, b.COMPLAINT[1])})", "complaint"), (f"({undenied(n, b.NEGATIVE[0])} OR {has(n, b.NEGATIVE[1])})", "negative_feedback"), (has(n, b.POSITIVE), "positive_feedback"),
        (f"(p.user_role = 'user' AND x.user_id_hash <> p.user_id_hash AND NOT {ask})", "peer_support"), (has(n, b.RESPONSE), "CTA_response"), (has(n, b.OFF_TOPIC), "off_topic"), (f"({urls} >= 1 OR {has(n, b.EXTERNAL)})", "external_information_sharing"),
        (has(n, b.INTENT), "purchase_or_usage_intent"), (has(n, b.PROJECT), "project_discussion"),
    ]
    return base() + f""", dup AS (SELECT message_id, prior_id FROM (SELECT a.message_id, b.message_id AS prior_id, row_number() OVER (PARTITION BY a.message_id ORDER BY b.ts DESC, b.message_id DESC) AS rn FROM x a JOIN x b
    ON a.community_id = b.community_id AND a.user_id_hash = b.user_id_hash AND a.campaign_id IS NOT DISTINCT FROM b.campaign_id AND a.norm = b.norm AND b.ts < a.ts AND a.ts - b.ts <= INTERVAL 1 HOUR WHERE a.user_role = 'moderator' AND b.user_role = 'moderator') WHERE rn = 1),
lab AS (SELECT x.message_id, x.community_id, x.user_role, CASE x.user_role WHEN 'moderator' THEN {_label_case(mod)} WHEN 'user' THEN {_label_case(usr)} ELSE 'unclassified' END AS behavior, p.message_id AS parent, d.prior_id
        FROM x LEFT JOIN x p ON x.reply_to_message_id = p.message_id LEFT JOIN dup d ON d.message_id = x.message_id)"""


#: Rules by role (where it matters) and label.
_RULES = (
    ("", "duplicate_promotion", "same_actor_campaign_window_exact_text_v1"), ("", "filler", "language_filler_v1"), ("", "spam", "repeated_link_or_spam_phrase_v1"), ("", "question_answering", "moderator_reply_to_question_v1"),
    ("", "conversation_initiation", "moderator_root_question_v1"), *[("moderator", label, rule) for label, rule, _ in b.MODERATOR_PHRASES], ("moderator", "campaign_propagation", "campaign_fact_phrase_v1"), ("moderator", "normal_chat", "moderator_social_phrase_v1"),
    ("user", "product_question", "product_question_phrase_v1"), ("user", "campaign_question", "campaign_question_phrase_v1"), ("user", "FUD", "fud_phrase_v1"), ("user", "feature_request", "feature_request_phrase_v1"), ("user", "complaint", "complaint_phrase_v1"),
    ("user", "negative_feedback", "negative_feedback_phrase_v1"), ("user", "positive_feedback", "positive_feedback_phrase_v1"), ("user", "peer_support", "user_reply_to_peer_v1"), ("user", "CTA_response", "cta_response_phrase_v1"), ("user", "off_topic", "off_topic_phrase_v1"),
    ("user", "external_information_sharing", "external_source_or_url_v1"), ("user", "purchase_or_usage_intent", "purchase_or_usage_intent_phrase_v1"), ("user", "project_discussion", "project_discussion_phrase_v1"),
)


#: A frame of observations with text values, some of them bad, for the metric queries.
FRAME = """WITH f AS (SELECT c_custkey AS observation_id, 'g' || (c_custkey % 3) AS community_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 13 = 0 THEN NULL ELSE 'n' || c_nationkey END AS language,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'bad' WHEN c_custkey % 23 = 0 THEN 'Infinity' WHEN c_custkey % 29 = 0 THEN '-Infinity' ELSE c_acctbal::VARCHAR END AS balance,
  (c_custkey % 50)::VARCHAR AS residue, (c_custkey * c_custkey % 101)::VARCHAR AS square FROM customer),
l AS (SELECT observation_id, community_id, language, unnest(['balance', 'residue', 'square']) AS metric_name, unnest([balance, residue, square]) AS raw FROM f),
v AS (SELECT *, try_cast(raw AS DOUBLE) AS d, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS x FROM l)"""
_RANKS = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


#: Of (metric_a, metric_b, n, rho) the two-sided p of Student's t, by sums over the angle whose tangent is t over the root of its degrees of freedom.
_TAIL = """an AS (SELECT *, atan(abs(rho) / sqrt(greatest(1 - rho * rho, 1e-300))) AS th FROM rho),
tail AS (SELECT metric_a, metric_b, any_value(n) AS n, any_value(rho) AS rho, greatest(1 - sum(pow(cos((i + 0.5) * th / 20000), n - 3)) * any_value(th) / (sum(pow(cos((i + 0.5) * pi() / 40000), n - 3)) * pi() / 2), 0.0) AS p FROM an, (SELECT unnest(range(20000)) AS i) GROUP BY metric_a, metric_b)"""


def oracle_sql() -> dict[str, str]:
    r = {}
    r["hygiene_by_community"] = POSTS + f""", g AS (SELECT community_id, norm, user_id_hash, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT community_id, norm, sum(n) AS n, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS rep FROM g GROUP BY ALL)
SELECT community_id, sum(n)::BIGINT AS message_count, round(sum(n - 1) / sum(n)::DOUBLE, 9) AS duplicate_ratio, round(sum(CASE WHEN norm IN ({', '.join(map(quote, t.FILLER_TERMS))}) OR length(norm) <= 3 THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS filler_ratio, round(sum(rep) / sum(n)::DOUBLE, 9) AS repetitive_content_ratio FROM q GROUP BY 1"""
    r["exact_duplicates"] = POSTS + " SELECT message_id, community_id, sha256(norm) AS group_id, n AS group_size FROM (SELECT *, count(*) OVER (PARTITION BY community_id, norm) AS n FROM p) WHERE n >= 2"
    r["repeated_content"] = POSTS + " SELECT message_id, user_id_hash, sha256(norm) AS group_id, n AS group_size FROM (SELECT *, count(*) OVER (PARTITION BY user_id_hash, norm) AS n FROM p) WHERE n >= 2"
    r["bursts"] = """WITH a AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT *, min(rn) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS lft FROM a),
e AS (SELECT user_id, lft, rn FROM (SELECT *, lead(lft) OVER (PARTITION BY user_id ORDER BY rn) AS nxt FROM w) WHERE (nxt IS NULL OR nxt <> lft) AND rn - lft + 1 >= 3)
SELECT e.user_id, min(a.ts) AS start_time, max(a.ts) AS end_time, count(*) AS message_count, string_agg(a.event_id::VARCHAR, ',' ORDER BY a.rn) AS event_ids FROM e JOIN a ON a.user_id = e.user_id AND a.rn BETWEEN e.lft AND e.rn GROUP BY e.user_id, e.lft, e.rn"""
    r["reply_edges"] = base() + " SELECT community_id, edge, count(*) AS replies FROM e GROUP BY ALL"
    r["thread_depth"] = base() + " SELECT message_id, root_id, depth::BIGINT AS depth FROM th"
    r["thread_branching"] = base() + " SELECT root_id, round(avg(n), 9) AS branching_factor, max(n) AS most_replies FROM (SELECT root_id, x.reply_to_message_id, count(*) AS n FROM x JOIN th USING (message_id) WHERE depth > 1 GROUP BY ALL) GROUP BY 1"
    r["episodes"] = base() + """, pl AS (SELECT x.*, root_id, depth FROM x JOIN th USING (message_id)), ed AS (SELECT message_id, edge FROM e), br AS (SELECT root_id, avg(n) AS b FROM (SELECT root_id, reply_to_message_id, count(*) AS n FROM pl WHERE depth > 1 GROUP BY ALL) GROUP BY 1)
SELECT pl.root_id, any_value(pl.community_id) AS community_id, count(*) AS message_count, max(depth)::BIGINT AS conversation_depth, round(coalesce(any_value(b), 0.0), 9) AS branching_factor, count(DISTINCT CASE WHEN user_role <> 'bot' THEN user_id_hash END) AS participants,
 count(*) FILTER (user_role = 'user') AS user_messages, count(*) FILTER (user_role = 'moderator') AS moderator_messages, count(*) FILTER (edge = 'self') AS self_replies, count(*) FILTER (edge = 'user_to_user') AS user_replies, count(*) FILTER (edge = 'user_to_moderator') AS moderator_replies,
 epoch(max(ts)) - epoch(min(ts)) AS duration_seconds, epoch(min(ts) FILTER (user_role <> 'bot' AND depth > 1)) - epoch(min(ts) FILTER (depth = 1)) AS first_response_seconds, count(*) FILTER (asks) AS questions, count(*) FILTER (asks AND pl.message_id IN (SELECT question_id FROM ca)) AS answered_questions
FROM pl LEFT JOIN ed USING (message_id) LEFT JOIN br ON br.root_id = pl.root_id GROUP BY pl.root_id"""
    r["response_latency"] = base() + ", fr AS (SELECT p_id, community_id, p_ts, min({'ts': ts, 'id': message_id}) AS r FROM e WHERE edge = 'user_to_moderator' GROUP BY ALL) SELECT p_id AS message_id, community_id, r.id AS reply_id, epoch(r.ts) - epoch(p_ts) AS latency_seconds FROM fr"
    r["candidate_answers"] = base() + " SELECT question_id, answer_id FROM ca"
    r["question_support"] = base() + f", {_QS} SELECT grp AS community_id, user_questions, unanswered, answered, peer_first FROM qs"
    r["activation_by_community"] = base() + f""", {_LATE}, ea AS (SELECT grp, count(*) FILTER (edge = 'self') AS s, count(*) FILTER (edge = 'user_to_user') AS u, count(*) FILTER (edge = 'user_to_user' AND p_asks AND NOT asks) AS p FROM e GROUP BY 1), la AS (SELECT grp, avg(epoch(r_ts) - epoch(p_ts)) AS l, count(*) AS k FROM late GROUP BY 1),
ba AS (SELECT grp, count(DISTINCT CASE WHEN user_role = 'user' THEN user_id_hash END) AS q, count(*) FILTER (user_role = 'user') AS um, count(*) FILTER (user_role = 'moderator') AS mm, count(*) FILTER (user_role = 'user' AND meaningful) AS mf, min(ts) AS a, max(ts) AS z FROM x GROUP BY 1)
SELECT grp AS community_id, q AS unique_engaged_users, um AS user_messages, mm AS moderator_messages, coalesce(s, 0) AS self_reply_count, round(coalesce(coalesce(u, 0) / nullif(um, 0)::DOUBLE, 0), 9) AS user_to_user_interaction_ratio, round(coalesce(coalesce(p, 0) / nullif(u, 0)::DOUBLE, 0), 9) AS peer_support_edge_ratio,
 round(coalesce(mf / nullif(um, 0)::DOUBLE, 0), 9) AS meaningful_interaction_ratio, round(l, 6) AS response_latency_seconds, coalesce(k, 0) AS responses, a AS observed_start, z AS observed_end FROM ba LEFT JOIN ea USING (grp) LEFT JOIN la USING (grp)"""
    r["scope_messages"] = BASE + " SELECT camp.campaign_id AS scope_id, g.community_id, count(m.message_id) AS messages, count(m.message_id) FILTER (user_role = 'user') AS user_messages FROM camp CROSS JOIN (SELECT DISTINCT community_id FROM m) g LEFT JOIN m ON m.community_id = g.community_id AND ts >= s AND ts < e GROUP BY ALL"
    r["claim_judgments"] = BASE + f", {_JUDGED} SELECT * FROM judged"
    r["campaign_summary"] = BASE + f", {_JUDGED} SELECT *, round((covered + 0.5 * partially_covered) / total_claims, 9)::DOUBLE AS semantic_coverage, round(covered / total_claims, 9)::DOUBLE AS claim_completeness FROM summ"
    wide = base("sc", "scope || '|' || community_id") + f""", {_JUDGED.replace('hit AS', 'hit_ AS').replace('FROM hit ', 'FROM hit_ ').replace('one AS', 'one_ AS').replace('LEFT JOIN one ', 'LEFT JOIN one_ ')}, {_LATE}, {_QS},
cn AS (SELECT grp, count(*) FILTER (user_role = 'user') AS u, count(*) FILTER (user_role = 'user' AND campaign_id = scope) AS cu, count(*) FILTER (user_role = 'user' AND campaign_id IS NULL) AS fu, count(*) FILTER (user_role = 'user' AND campaign_id IS NULL AND mention) AS mn, count(*) FILTER (user_role = 'user' AND meaningful) AS mf FROM x GROUP BY 1),
ue AS (SELECT grp, count(*) AS k FROM e WHERE edge = 'user_to_user' GROUP BY 1), lt AS (SELECT grp, avg(epoch(r_ts) - epoch(p_ts)) AS l FROM late GROUP BY 1), dp AS (SELECT grp, avg(dd) AS d FROM (SELECT root_id, max(depth) AS dd FROM th GROUP BY 1) JOIN x ON x.message_id = root_id GROUP BY 1),
wide AS (SELECT s.campaign_id AS scope_id, s.community_id, round(cu / nullif(u, 0)::DOUBLE, 9) AS campaign_discussion_share, round(l, 6) AS community_response_latency, round(d, 9) AS conversation_propagation_depth, round(mf / nullif(u, 0)::DOUBLE, 9) AS meaningful_interaction_ratio, round(mn / nullif(fu, 0)::DOUBLE, 9) AS organic_project_mention_rate,
 round(peer_first / nullif(answered, 0)::DOUBLE, 9) AS peer_support_ratio, round((covered + 0.5 * partially_covered) / total_claims, 9)::DOUBLE AS semantic_campaign_coverage, round(semantic_drift_count / total_claims, 9)::DOUBLE AS semantic_drift_rate, round(unanswered / nullif(user_questions, 0)::DOUBLE, 9) AS unanswered_question_rate, round(coalesce(k, 0) / nullif(u, 0)::DOUBLE, 9) AS user_to_user_interaction_ratio
 FROM summ s LEFT JOIN cn ON cn.grp = s.campaign_id || '|' || s.community_id LEFT JOIN ue USING (grp) LEFT JOIN lt USING (grp) LEFT JOIN dp USING (grp) LEFT JOIN qs USING (grp))"""
    r["scope_metrics_wide"] = wide + " SELECT * FROM wide"
    from .report import METRICS

    r["scope_metrics_long"] = wide + " " + " UNION ALL ".join(f"SELECT scope_id, community_id, {quote(k)} AS metric_name, {k} AS metric_value, CASE WHEN {k} IS NULL THEN 'zero_denominator' ELSE 'observed' END AS diagnostic_reason FROM wide" for k in METRICS)
    rule = "CASE WHEN user_role NOT IN ('moderator', 'user') THEN 'bot_not_classified_v1' " + " ".join(f"WHEN behavior = {quote(k)}{f' AND user_role = {quote(role)}' if role else ''} THEN {quote(v)}" for role, k, v in _RULES) + " ELSE 'no_seed_rule_match_v1' END"
    sure = "CASE WHEN behavior = 'unclassified' THEN 0.0 WHEN behavior = 'duplicate_promotion' THEN 0.85 WHEN behavior = 'filler' THEN 0.55 WHEN behavior IN ('question_answering', 'peer_support') THEN 0.8 ELSE 0.65 END"
    seen = "CASE WHEN behavior = 'duplicate_promotion' THEN prior_id || ',' || message_id WHEN behavior IN ('question_answering', 'peer_support') THEN parent || ',' || message_id ELSE message_id END"
    r["seed_behavior_labels"] = _labels() + f" SELECT message_id, community_id, user_role, behavior, {rule} AS rule_id, ({sure})::DOUBLE AS confidence, {seen} AS evidence_ids FROM lab"
    r["duplicate_promotion"] = _labels() + " SELECT message_id, prior_id FROM dup"
    r["feedback_counts"] = _labels() + f" SELECT behavior, count(lab.message_id) AS message_count FROM {values([(x,) for x in b.FEEDBACK_LABELS], 'behavior')} LEFT JOIN lab USING (behavior) GROUP BY 1"
    r["metric_quality"] = FRAME + " SELECT metric_name, count(*) AS sample_size, count(*) FILTER (raw IS NULL OR isnan(d)) AS raw_missing_count, count(*) FILTER (raw IS NOT NULL AND d IS NULL) AS invalid_nonnumeric_count, count(*) FILTER (d = 'inf'::DOUBLE) AS positive_infinity_count, count(*) FILTER (d = '-inf'::DOUBLE) AS negative_infinity_count, count(x) AS finite_count, round(avg(x), 6) AS mean, round(var_pop(x), 3) AS variance FROM v GROUP BY 1"
    r["group_diagnostics"] = FRAME + ", g AS (SELECT metric_name, language, count(x) AS n, avg(x) AS a FROM v WHERE trim(language) <> '' GROUP BY ALL) SELECT metric_name, (SELECT count(*) FROM v w WHERE w.metric_name = g.metric_name AND coalesce(trim(language), '') = '') AS excluded_group_count, count(*) AS group_count, count(*) FILTER (n >= 3) AS adequate_group_count, round(CASE WHEN count(*) FILTER (n >= 3) >= 2 THEN max(a) FILTER (n >= 3) - min(a) FILTER (n >= 3) END, 6) AS spread, CASE WHEN count(*) FILTER (n >= 3) >= 2 THEN 'descriptive_comparison' ELSE 'insufficient_groups' END AS status FROM g GROUP BY 1"
    pairs = FRAME + ", pr AS (SELECT a.metric_name AS metric_a, b.metric_name AS metric_b, a.x, b.x AS y FROM v a JOIN v b USING (observation_id) WHERE a.metric_name < b.metric_name AND a.x IS NOT NULL AND b.x IS NOT NULL), rk AS (SELECT *, " + _RANKS.format(by="metric_a, metric_b", v="x") + " AS rx, " + _RANKS.format(by="metric_a, metric_b", v="y") + " AS ry FROM pr), rho AS (SELECT metric_a, metric_b, count(*) AS n, corr(rx, ry) AS rho FROM rk GROUP BY ALL)"
    r["spearman_pairs"] = pairs + " SELECT metric_a, metric_b, n, round(rho, 9) AS rho FROM rho"
    r["redundancy"] = pairs + " SELECT metric_a, metric_b, n AS paired_sample_size, round(rho, 9) AS rho, CASE WHEN abs(rho) >= 0.9 THEN 'absolute_spearman_at_or_above_threshold' ELSE 'absolute_spearman_below_threshold' END AS reason FROM rho"
    r["fisher_intervals"] = pairs + " SELECT metric_a, metric_b, round(tanh(atanh(rho) - 1.96 / sqrt(n - 3)), 9) AS low, round(tanh(atanh(rho) + 1.96 / sqrt(n - 3)), 9) AS high FROM rho"
    r["holm_adjust"] = "WITH p AS (SELECT n_nationkey AS test_id, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE (n_nationkey * 37 % 100) / 2000.0 END::DOUBLE AS raw_p FROM nation), k AS (SELECT *, row_number() OVER (ORDER BY raw_p ASC NULLS LAST, test_id) AS rn, count(*) OVER () AS m FROM p) SELECT test_id, raw_p, round(CASE WHEN raw_p IS NOT NULL THEN least(1.0, max((m - rn + 1) * raw_p) OVER (ORDER BY rn)) END, 9) AS adjusted_p FROM k"
    r["role_asof"] = BASE + ", ra AS (SELECT 'usr_' || (c_custkey % 29) AS u, CASE c_custkey % 3 WHEN 0 THEN 'moderator' WHEN 1 THEN 'user' ELSE 'bot' END AS role, TIMESTAMP '2024-01-01' + to_hours((c_custkey % 50)::BIGINT) AS vf, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours((c_custkey % 50 + 20)::BIGINT) END AS vt, c_custkey AS version FROM customer WHERE c_custkey % 5 = 0) SELECT message_id, user_role, coalesce((SELECT max_by(role, version) FROM ra WHERE u = user_id_hash AND vf <= ts AND (vt IS NULL OR ts < vt)), user_role) AS resolved_role FROM m"
    r["actor_rollup"] = BASE + " SELECT community_id, user_id_hash, count(*) AS message_count, min(ts) AS first_message_at, max(ts) AS last_message_at FROM m GROUP BY ALL"
    r["freshness"] = BASE + " SELECT g.community_id, max(ts) AS latest_message_at, epoch(TIMESTAMP '2024-01-05 12:00:00') - epoch(max(ts)) AS age_seconds, CASE WHEN max(ts) IS NULL THEN 'no_data' WHEN epoch(TIMESTAMP '2024-01-05 12:00:00') - epoch(max(ts)) <= 86400 THEN 'current' ELSE 'stale' END AS status FROM (SELECT unnest(['g0', 'g1', 'g2', 'g3', 'g9']) AS community_id) g LEFT JOIN m ON m.community_id = g.community_id AND ts < TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1"
    r["window_vs_baseline"] = BASE + " SELECT community_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-03') AS messages, count(*) FILTER (ts < TIMESTAMP '2024-01-03') AS baseline_messages, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2024-01-03' THEN user_id_hash END) AS users, count(DISTINCT CASE WHEN ts < TIMESTAMP '2024-01-03' THEN user_id_hash END) AS baseline_users FROM m WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04' GROUP BY 1"
    r["list_messages"] = BASE + " SELECT message_id, ts AS timestamp FROM m WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'"
    r["late_reply_resolution"] = BASE + " SELECT message_id, reply_to_message_id FROM m"
    r["import_merge"] = BASE + " SELECT message_id, CASE WHEN conv_id % 2 = 0 THEN 'old' ELSE 'new' END AS batch FROM m"
    docs = "WITH d AS (SELECT doc_id AS chunk_id, doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM documents), ix AS (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM d), po AS (SELECT term, chunk_id, count(*) AS tf, any_value(length) AS length FROM ix GROUP BY ALL), tot AS (SELECT count(*) AS chunks, sum(len(w)) AS tokens FROM d), qs AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+'))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1), sc AS (SELECT query_id, chunk_id, round(sum(ln((chunks - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (tokens / chunks)))), 9) AS score FROM po JOIN qs USING (term) JOIN df USING (term) CROSS JOIN tot GROUP BY ALL), lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 40)"
    r["bm25_topk"] = docs + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex"
    vec = "vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), vs AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score FROM embeddings, vq), sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs QUALIFY rank <= 10)"
    r["vector_topk"] = f"WITH {vec} SELECT query_id, vec_id, rank FROM sem"
    two = docs + ", lb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (chunk_id * 31 + query_id * 17) % 1009, chunk_id) AS rank FROM lex)"
    r["rrf_fusion"] = two + " SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS rrf, count(*) AS channels FROM (SELECT query_id, chunk_id, rank FROM lex WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM lb WHERE rank <= 20) GROUP BY ALL"
    pool = two + ", fu AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS rrf, count(*) AS channels FROM (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM lb WHERE rank <= 20) GROUP BY ALL), cd AS (SELECT *, CASE chunk_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'future' END AS state, CASE WHEN chunk_id % 7 = 0 THEN 'community' ELSE 'verified_official' END AS off, CASE WHEN chunk_id % 11 = 0 THEN 'draft' ELSE 'current' END AS st, 's' || (CASE WHEN query_id % 2 = 0 AND chunk_id % 5 < 4 THEN 0 ELSE chunk_id % 6 END) AS source_id FROM fu), ok AS (SELECT *, max(CASE WHEN state = 'active' THEN rrf END) OVER (PARTITION BY query_id) AS best, max(CASE WHEN state = 'inactive' AND channels = 2 THEN rrf END) OVER (PARTITION BY query_id) AS top FROM cd WHERE off = 'verified_official' AND st NOT IN ('draft', 'unknown') AND state <> 'future'), ld AS (SELECT *, min(CASE WHEN state = 'inactive' AND channels = 2 AND rrf = top AND rrf > best THEN chunk_id END) OVER (PARTITION BY query_id) AS lead FROM ok), sel AS (SELECT query_id, chunk_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN chunk_id = lead THEN 0 ELSE 1 END, CASE state WHEN 'active' THEN 0 ELSE 1 END, rrf DESC, chunk_id) AS place FROM ld)"
    r["select_candidates"] = pool + " SELECT query_id, chunk_id, place FROM sel WHERE place <= 8"
    r["source_diversity"] = pool + ", cu AS (SELECT * FROM sel WHERE place <= 20), bs AS (SELECT query_id, source_id, count(*) AS n, max(place) AS last, min(place) AS first FROM cu GROUP BY ALL), dm AS (SELECT query_id, arg_max(last, n * 1000 - first) AS gone FROM bs GROUP BY 1 HAVING sum(n) >= 20 AND max(n) > 10), un AS (SELECT * FROM sel ANTI JOIN bs USING (query_id, source_id)), nw AS (SELECT query_id, min({'place': place, 'chunk': chunk_id, 'source': source_id}) AS r FROM un GROUP BY 1) SELECT cu.query_id, cu.place, CASE WHEN cu.place = gone AND r IS NOT NULL THEN r.chunk ELSE chunk_id END AS chunk_id, CASE WHEN cu.place = gone AND r IS NOT NULL THEN r.source ELSE source_id END AS source_id FROM cu LEFT JOIN dm USING (query_id) LEFT JOIN nw USING (query_id)"
    r["retrieval_metrics"] = docs + ", gold AS (SELECT item_id AS query_id, doc_id AS target FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT g.query_id, rank, n FROM gold g JOIN n USING (query_id) JOIN lex ON lex.query_id = g.query_id AND lex.chunk_id = g.target), a AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= n) AS hr, min(rank) FILTER (rank <= 5) AS b, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1) SELECT q.query_id, " + ", ".join(f"CASE WHEN n IS NOT NULL THEN (coalesce(h{k}, 0) > 0)::INTEGER::DOUBLE END AS hit_at_{k}, round(CASE WHEN n IS NOT NULL THEN coalesce(h{k}, 0) / {k}.0 END::DOUBLE, 9) AS precision_at_{k}, round(coalesce(h{k}, 0) / n, 9) AS recall_at_{k}" for k in (1, 3, 5)) + ", round(coalesce(hr, 0) / n, 9) AS r_precision, round(CASE WHEN n IS NOT NULL THEN coalesce(1.0 / b, 0) END::DOUBLE, 9) AS mrr_at_5, round(CASE WHEN n IS NOT NULL THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))) END, 9) AS ndcg_at_5 FROM (SELECT item_id AS query_id FROM benchmark) q LEFT JOIN n USING (query_id) LEFT JOIN a USING (query_id)"
    rev = "WITH r AS (SELECT 's' || (doc_id % 50) AS source_id, sha256(text) AS content_hash, TIMESTAMP '2024-01-01' + to_hours(doc_id::BIGINT) AS effective_from FROM documents), f AS (SELECT source_id, content_hash, min(effective_from) AS effective_from FROM r GROUP BY ALL), ve AS (SELECT *, row_number() OVER w AS version, lead(effective_from) OVER w AS superseded_at FROM f WINDOW w AS (PARTITION BY source_id ORDER BY effective_from, content_hash))"
    r["scd2_versions"] = rev + " SELECT *, CASE WHEN superseded_at IS NULL THEN 'active' ELSE 'superseded' END AS status FROM ve"
    r["temporal_state"] = rev + " SELECT source_id, version, CASE WHEN TIMESTAMP '2024-01-20' < effective_from THEN 'future' WHEN TIMESTAMP '2024-01-20' >= superseded_at THEN 'inactive' ELSE 'active' END AS temporal_state FROM ve"
    ch = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '') AS w FROM documents), c AS (SELECT doc_id, i AS ordinal, w[i * 150 + 1:i * 150 + 180] AS p FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 180 THEN 1 ELSE (len(w) - 1) // 150 + 1 END)) AS i FROM w WHERE len(w) > 0)), ck AS (SELECT doc_id, ordinal::BIGINT AS ordinal, len(p) AS token_count, array_to_string(p, ' ') AS text FROM c)"
    r["window_chunks"] = ch + " SELECT doc_id, ordinal, token_count, sha256(text) AS text_sha256 FROM ck"
    nl = "chr(10) || chr(10)"
    tail = f" || {nl} || ".join(map(quote, ("## Part", "Q: what is this", "Question: and this", "last words", "### Deep", "end [Page 7]", "## Next", "How long?", "# Other", "plain")))
    level = [f"max(CASE WHEN lv = {k} THEN pos END) OVER w AS p{k}, last_value(CASE WHEN lv = {k} THEN name END IGNORE NULLS) OVER w AS n{k}" for k in range(1, 7)]
    holds = [f"CASE WHEN p{k} > greatest(0, " + ", ".join(f"coalesce(p{j}, 0)" for j in range(1, k)) + f"{', ' if k > 1 else ''}0) THEN n{k} END" for k in range(1, 7)]
    r["structured_chunks"] = f"""WITH c AS (SELECT doc_id, doc_id % 4 <> 0 AS faq, coalesce('# Guide ' || (doc_id % 3) || {nl} || replace(text, chr(10), {nl}) || {nl} || {tail}, '') AS content FROM documents),
sp AS (SELECT doc_id, faq, content, unnest(b) AS t, generate_subscripts(b, 1) AS pos FROM (SELECT *, regexp_split_to_array(content, '\\n\\s*\\n') AS b FROM c)),
bl AS (SELECT doc_id, faq, pos, t, CASE WHEN regexp_matches(t, '^(#{{1,6}})\\s+(.+?)\\s*$') THEN length(regexp_extract(t, '^(#{{1,6}})\\s+(.+?)\\s*$', 1)) END AS lv, regexp_extract(t, '^(#{{1,6}})\\s+(.+?)\\s*$', 2) AS name FROM (SELECT * REPLACE (regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t) FROM sp) WHERE t <> ''),
hd AS (SELECT *, last_value(CASE WHEN lv IS NOT NULL THEN name END IGNORE NULLS) OVER w AS section, count(lv) OVER w AS part, {", ".join(level)} FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
bo AS (SELECT doc_id, faq, pos, t, section, part, nullif(array_to_string(list_filter([{", ".join(holds)}], lambda z: z IS NOT NULL), ' > '), '') AS parent_heading FROM hd WHERE lv IS NULL
       UNION ALL SELECT doc_id, faq, 0, content, NULL, 0, NULL FROM c WHERE content = ''),
qu AS (SELECT *, faq AND regexp_matches(t, '(?i)^(?:(?:Q(?:uestion)?|P(?:regunta)?)\\s*[:：]|[^.!?。！？]{{2,120}}[?？])') AS asks, row_number() OVER s AS nth, lead(t) OVER s AS nxt FROM bo WINDOW s AS (PARTITION BY doc_id, part ORDER BY pos)),
ru AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, part, asks ORDER BY pos) AS run FROM qu), od AS (SELECT *, asks AND row_number() OVER (PARTITION BY doc_id, part, asks, run ORDER BY pos) % 2 = 1 AS odd FROM ru),
un AS (SELECT * REPLACE (CASE WHEN odd AND nxt IS NOT NULL THEN t || {nl} || nxt ELSE t END AS t) FROM od QUALIFY NOT coalesce(lag(odd) OVER (PARTITION BY doc_id, part ORDER BY pos), FALSE)),
wo AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda z: z <> '') AS w FROM un),
pi AS (SELECT doc_id, section, parent_heading, pos, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT *, CASE WHEN len(w) <= 180 THEN [t] ELSE list_transform(range(0, len(w), 150), lambda i: array_to_string(w[i + 1:i + 180], ' ')) END AS ps FROM wo)),
nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS ordinal FROM pi)
SELECT doc_id || ':' || ordinal AS chunk_id, doc_id AS revision_id, section, parent_heading, try_cast(nullif(regexp_extract(p, '\\[Page (\\d+)\\]', 1), '') AS BIGINT) AS page, ordinal, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda z: z <> '')) AS token_count, sha256(p) AS text_sha256 FROM nu"""
    r["neighbor_context"] = ch + ", h AS (SELECT doc_id, ordinal AS o FROM ck), nb AS (SELECT h.doc_id, h.o AS hit_ordinal, ck.ordinal, ck.text, coalesce(sum(length(ck.text)) OVER (PARTITION BY h.doc_id, h.o ORDER BY CASE WHEN ck.ordinal = h.o THEN 0 ELSE 1 END, ck.ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM h JOIN ck ON ck.doc_id = h.doc_id AND ck.ordinal BETWEEN h.o - 1 AND h.o + 1) SELECT doc_id, hit_ordinal, ordinal, least(length(text), 2000 - used)::BIGINT AS chars, sha256(substr(text, 1, (2000 - used)::BIGINT)) AS text_sha256 FROM nb WHERE used < 2000"
    r["quote_check"] = "WITH q AS (SELECT item_id, doc_id, b.text AS quote, d.text FROM benchmark b CROSS JOIN documents d) SELECT item_id, doc_id, trim(regexp_replace(quote, '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS found FROM q"
    stop = ", ".join(map(quote, t.STOP_TERMS))
    r["search_terms"] = f"SELECT item_id, array_to_string(list_distinct_ordered, ',') AS terms FROM (SELECT item_id, list_filter(tt, lambda z, i: list_position(tt, z) = i) AS list_distinct_ordered FROM (SELECT item_id, list_transform(list_filter(list_transform(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda z: replace(lower(z), 'ß', 'ss')), lambda z: length(z) > 1 AND z NOT IN ({stop})), lambda z: CASE WHEN regexp_matches(z, '^[\\x00-\\x7F]{{4,}}s$') THEN substr(z, 1, length(z) - 1) ELSE z END) AS tt FROM benchmark))"
    r["sender_concentration"] = BASE + ", c AS (SELECT community_id, user_id_hash, count(*) AS n FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, user_id_hash) AS rk FROM c) SELECT community_id, count(*) AS senders, sum(n)::BIGINT AS messages, round(sum(CASE WHEN rk <= 1 THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS top_sender_share, round(sum(CASE WHEN rk <= 10 THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS top_senders_share FROM k GROUP BY 1"
    r["repeated_text_rate"] = "WITH x AS (SELECT source AS community_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\pM_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM documents), g AS (SELECT community_id, k, count(*) AS n FROM x GROUP BY ALL) SELECT community_id, sum(n)::BIGINT AS messages, round(sum(CASE WHEN n > 1 AND k <> '' THEN n ELSE 0 END) / sum(n)::DOUBLE, 9) AS repeated_text_rate FROM g GROUP BY 1"
    r["candidate_kinds"] = BASE + " SELECT community_id, count(*) AS messages, count(*) FILTER (regexp_matches(text, '(?i)\\?|\\b(how|what|when|where|why|who|can (i|we|you)|does anyone|help|which)\\b')) AS question_help, count(*) FILTER (regexp_matches(text, '(?i)\\b(try|use|you can|buy on|available|works|worked|link|here|kraken|uphold|binance|coinbase|wallet|exchange)\\b') AND reply_to_message_id IS NOT NULL) AS support_replies, count(*) FILTER (regexp_matches(text, '(?i)\\b(xrp|ripple|sec|ledger|wallet|exchange|buy|hold|pump|price|february|feb|est)\\b')) AS project_discussion, count(*) FILTER (regexp_matches(text, '(?i)\\b(scam|fake|cannot|can''t|cant|not working|doesn''t work|problem|issue|lost|dump|blocked|banned|admin|lock(ed)?)\\b')) AS complaint, count(*) FILTER (len(regexp_extract_all(text, '[\\pL\\pN_'']+')) <= 3) AS filler, count(reply_to_message_id) AS resolved_replies FROM m GROUP BY 1"
    gone = "html"
    for pattern, to in (("<script\\b.*?</script\\s*>", ""), ("<style\\b.*?</style\\s*>", ""), ("<br\\s*/?>|</(p|div|li|h[1-6]|tr)\\s*>", "chr(10)"), ("<[^>]*>", "")):
        gone = f"regexp_replace({gone}, {quote(pattern)}, {to or quote('')}, 'gis')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
        gone = f"replace({gone}, {quote(name)}, {quote(char)})"
    gone = f"regexp_replace({gone}, '&amp;?', '&', 'g')"  # the one name that also stands without its semicolon here
    r["html_text_extract"] = f"WITH x AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({gone}, chr(10)), lambda z: trim(z)), lambda z: z <> ''), chr(10)) AS t FROM pages) SELECT page_id, length(t) AS n_chars, len(string_split(t, chr(10))) AS n_lines, sha256(t) AS text_sha256 FROM x"
    r["evidence_union"] = BASE + ", u AS (SELECT message_id FROM m WHERE user_role = 'user' UNION SELECT reply_to_message_id FROM m WHERE reply_to_message_id IS NOT NULL) SELECT community_id, count(*) AS evidence_rows FROM u JOIN m USING (message_id) GROUP BY 1"
    r["evidence_integrity"] = BASE + " SELECT 'missing' AS problem, count(*) AS n FROM m WHERE user_role <> 'user' AND conv_id % 2 = 0 UNION ALL SELECT 'unreferenced', count(*) FROM m WHERE user_role = 'user' AND conv_id % 2 = 1"
    at = lambda a, b: f"conv_id % {a} = {b} AND turn = 1"
    circle = "CASE WHEN turn = 0 THEN 'c' || conv_id || '_2' WHEN turn <= 2 THEN 'c' || conv_id || '_' || (turn - 1) ELSE reply_to_message_id END"
    bad = f"""SELECT message_id AS id, conv_id, turn, CASE WHEN {at(9, 4)} THEN 'nowhere' WHEN {at(11, 5)} THEN message_id WHEN conv_id % 13 = 6 THEN {circle} ELSE reply_to_message_id END AS rp, CASE WHEN conv_id % 8 = 3 THEN 'owner' ELSE user_role END AS ro,
        CASE WHEN {at(10, 7)} THEN ' ' WHEN conv_id % 7 = 2 AND turn = 2 THEN 'g9' ELSE community_id END AS co, CASE WHEN {at(10, 3)} THEN '' ELSE text END AS tx, CASE WHEN {at(12, 8)} THEN 'english!' ELSE language END AS la,
        CASE WHEN {at(15, 1)} THEN 'bob' ELSE user_id_hash END AS us, CASE WHEN {at(16, 9)} THEN ts - INTERVAL 30 DAY ELSE ts END AS tm, CASE WHEN conv_id % 6 = 1 AND turn = 2 THEN 'camp_x' ELSE campaign_id END AS ca FROM m"""
    count = lambda rule, where: f"SELECT '{rule}' AS rule, count(*) AS n FROM {where}"
    edge = "b c JOIN b p ON c.rp = p.id WHERE "
    r["message_violations"] = BASE + f""", b0 AS ({bad}), b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE conv_id % 17 = 3 AND turn = 0),
reach AS (SELECT DISTINCT id FROM b WHERE rp IS NULL OR rp NOT IN (SELECT id FROM b) UNION SELECT b.id FROM b JOIN reach ON b.rp = reach.id) """ + " UNION ALL ".join([
        count("duplicate_message_id", "(SELECT id FROM b GROUP BY id HAVING count(*) > 1)"), count("blank_message_id", "b WHERE trim(coalesce(id, '')) = ''"), count("blank_community_id", "b WHERE trim(coalesce(co, '')) = ''"), count("blank_text", "b WHERE trim(coalesce(tx, '')) = ''"),
        count("unknown_role", "b WHERE ro NOT IN ('moderator', 'user', 'bot')"), count("malformed_user_id", "b WHERE NOT regexp_full_match(us, 'usr_[0-9a-f]+')"), count("malformed_language", "b WHERE NOT regexp_full_match(la, '[a-z]{2,3}(-[a-z0-9]{2,8})*')"),
        count("missing_parent", "b WHERE rp IS NOT NULL AND rp NOT IN (SELECT id FROM b)"), count("self_reply", "b WHERE id = rp"), count("cross_community_reply", edge + "c.co <> p.co"), count("cross_campaign_reply", edge + "c.ca <> p.ca"), count("reply_before_parent", edge + "c.tm < p.tm"),
        count("cycle", "b WHERE id NOT IN (SELECT id FROM reach)"),
    ])
    fact = lambda i: f"CASE WHEN (doc_id + {i}) % 31 = 0 THEN 'ai-inferred' WHEN (doc_id + {i}) % 37 = 0 THEN 'guessed' ELSE 'human-confirmed' END"
    there = [fact(i) if i < 4 else f"CASE WHEN doc_id % 41 <> 0 THEN {fact(i)} END" for i in range(5)]
    url = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'ftp' ELSE 'https' END"
    broken = (
        ("unsupported_source_type", "doc_id % 19 = 0"), ("unsupported_source_channel", "doc_id % 17 = 0"), ("unsupported_status", "doc_id % 23 = 0"), ("blank_title_or_content", "doc_id % 29 = 0 OR trim(coalesce(text, ''), ' ') = ''"),
        ("missing_canonical_url", f"({url}) IS NULL AND NOT (doc_id % 17 <> 0 AND doc_id % 3 = 0)"), ("unsupported_canonical_url", f"({url}) = 'ftp'"), ("empty_validity", "doc_id % 13 = 0"), ("missing_provenance", "doc_id % 41 = 0"),
        ("unsupported_provenance", " OR ".join(f"coalesce({x}, '') = 'guessed'" for x in there)), ("inferred_critical_metadata", " OR ".join(f"coalesce({x}, '') = 'ai-inferred'" for x in there)),
    )
    r["source_violations"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n FROM documents WHERE {w}" for k, w in broken) + ") WHERE n > 0"
    r["tfidf_weights"] = BASE + ", g AS (SELECT message_id, unnest(flatten(list_transform([2, 3, 4], lambda k: list_transform(range(1, greatest(length(norm) - k + 2, 1)), lambda i: substr(norm, i, k))))) AS term FROM m), tf AS (SELECT message_id, term, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), nn AS (SELECT count(*) AS n FROM m), w AS (SELECT message_id, (1 + ln(tf)) * (ln((1 + nn.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term) CROSS JOIN nn) SELECT message_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS weight_sum FROM w GROUP BY 1"
    r["stream_without_repeats"] = "SELECT event_id, user_id FROM events"
    r["stream_activity"] = "SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS message_count FROM events GROUP BY ALL"
    r["latency_percentiles"] = base() + ", fr AS (SELECT p_id, community_id, epoch(min(ts)) - epoch(any_value(p_ts)) AS l FROM e WHERE edge = 'user_to_moderator' GROUP BY 1, 2) SELECT community_id, quantile_disc(l, 0.5) AS p50, quantile_disc(l, 0.95) AS p95 FROM fr GROUP BY 1"
    r["key_differences"] = "SELECT 'left_only' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'right_only', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"
    family = """WITH f AS (SELECT c_custkey AS observation_id, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'bad' WHEN c_custkey % 23 = 0 THEN 'Infinity' WHEN c_custkey % 29 = 0 THEN '-Infinity' ELSE c_acctbal::VARCHAR END AS balance, (c_custkey % 50)::VARCHAR AS residue,
  (c_custkey * c_custkey % 101)::VARCHAR AS square, (c_custkey % 50 * 3 + c_custkey % 7)::VARCHAR AS echo, '1' AS flat, CASE WHEN c_custkey <= 3 THEN c_custkey::VARCHAR END AS rare, c_custkey % 50 * 2 + c_custkey % 11 AS growth, c_custkey * 7 % 13 AS noise FROM customer),
l AS (SELECT observation_id, unnest(['balance', 'residue', 'square', 'echo', 'flat', 'rare']) AS metric_a, unnest([balance, residue, square, echo, flat, rare]) AS raw FROM f),
v AS (SELECT *, try_cast(raw AS DOUBLE) AS d, CASE WHEN isfinite(try_cast(raw AS DOUBLE)) THEN try_cast(raw AS DOUBLE) END AS x FROM l),
o AS (SELECT observation_id, unnest(['growth', 'noise']) AS metric_b, unnest([growth, noise])::DOUBLE AS y FROM f),
pr AS (SELECT metric_a, metric_b, x, y FROM v JOIN o USING (observation_id) WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, """ + _RANKS.format(by="metric_a, metric_b", v="x") + " AS rx, " + _RANKS.format(by="metric_a, metric_b", v="y") + """ AS ry FROM pr),
rho AS (SELECT metric_a, metric_b, count(*) AS n, CASE WHEN count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk GROUP BY ALL), """ + _TAIL + """,
tests AS (SELECT metric_a AS metric_name, metric_b AS outcome_name, n, rho, CASE WHEN n >= 20 THEN p END AS raw_p, CASE WHEN n < 5 OR rho IS NULL THEN 'unavailable' WHEN n < 20 THEN 'descriptive_only_small_sample' ELSE 'asymptotic_spearman' END AS inference_method FROM tail),
step AS (SELECT *, row_number() OVER (ORDER BY raw_p NULLS LAST, metric_name, outcome_name) AS rn, count(*) OVER () AS m FROM tests),
adj AS (SELECT *, CASE WHEN raw_p IS NOT NULL THEN least(1.0, max((m - rn + 1) * raw_p) OVER (ORDER BY rn)) END AS adjusted_p FROM step)"""
    r["metric_tests"] = family + " SELECT metric_name, outcome_name, n, round(rho, 7) AS rho, round(raw_p, 7) AS raw_p, round(adjusted_p, 7) AS adjusted_p, inference_method FROM adj"
    r["metric_status"] = family + """, good AS (SELECT metric_name, bool_or(coalesce(abs(rho) >= 0.3 AND adjusted_p <= 0.05, FALSE)) AS g FROM adj GROUP BY 1),
q AS (SELECT metric_a AS metric_name, count(*) AS n, count(*) FILTER (raw IS NULL) AS miss, count(*) FILTER (raw IS NOT NULL AND d IS NULL) AS bad, count(*) FILTER (isinf(d)) AS inf, count(x) AS fin, var_pop(x) AS var FROM v GROUP BY 1),
s AS (SELECT *, CASE WHEN bad + inf > 0 OR fin < 5 OR var = 0 THEN 'Rejected' WHEN g THEN 'Promising' ELSE 'Candidate' END AS status FROM q LEFT JOIN good USING (metric_name))
SELECT metric_name, status, array_to_string(list_filter([CASE WHEN miss = n THEN 'all_missing' END, CASE WHEN bad > 0 THEN 'invalid_nonnumeric_values' END, CASE WHEN inf > 0 THEN 'infinite_values' END, CASE WHEN fin < 5 THEN 'insufficient_sample' END,
  CASE WHEN var = 0 THEN 'zero_variance' END, CASE WHEN status = 'Promising' THEN 'synthetic_association_only' END], lambda z: z IS NOT NULL), ',') AS reasons FROM s"""
    r["metric_associations"] = pairs + ", " + _TAIL + """ SELECT metric_a, metric_b, n, round(rho, 7) AS rho, round(p, 7) AS raw_p, 'asymptotic_spearman' AS inference_method, round(tanh(atanh(least(greatest(rho, -0.999999), 0.999999)) - 1.96 / sqrt(n - 3)), 7) AS low,
  round(tanh(atanh(least(greatest(rho, -0.999999), 0.999999)) + 1.96 / sqrt(n - 3)), 7) AS high FROM tail"""
    r["knowledge_revisions"] = """WITH c AS (SELECT 's' || (doc_id % 50) AS source_id, sha256(coalesce(text, '')) AS content_hash, TIMESTAMP '2024-01-01' + to_hours(doc_id::BIGINT) AS effective_from, (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1000000000 END) + doc_id AS arrived FROM documents),
f AS (SELECT source_id, content_hash, min(arrived) AS arrived, arg_min(effective_from, arrived) AS effective_from FROM c GROUP BY ALL)
SELECT source_id, row_number() OVER w AS version, content_hash, CASE WHEN lead(arrived) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS status, effective_from, lead(effective_from) OVER w AS superseded_at FROM f WINDOW w AS (PARTITION BY source_id ORDER BY arrived)"""
    terms = lambda c: f"list_filter(list_transform(list_filter(list_transform(regexp_extract_all({c}, '[\\pL\\pN_]+'), lambda z: replace(lower(z), 'ß', 'ss')), lambda z: length(z) > 1 AND z NOT IN ({stop})), lambda z: CASE WHEN regexp_matches(z, '^[\\x00-\\x7F]{{4,}}s$') THEN substr(z, 1, length(z) - 1) ELSE z END), lambda z: TRUE)"
    store = ch + f""", ix AS (SELECT doc_id, ordinal, doc_id || ':' || ordinal AS chunk_id, text, 'Title: guide ' || (doc_id % 40) || chr(10) || chr(10) || text AS body FROM ck),
bw AS (SELECT chunk_id, list_concat(regexp_extract_all(lower(body), '[\\pL\\pN_]+'), list_distinct({terms('body')})) AS w FROM ix), po AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM bw) GROUP BY ALL),
tot AS (SELECT count(*) AS chunks, sum(len(w)) AS tokens FROM bw), q AS (SELECT item_id AS query_id, list_distinct({terms('text')}) AS qt, CASE WHEN item_id % 3 <> 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-02-10' END AS wh FROM benchmark WHERE trim(text) <> '' AND length(text) <= 8000),
qs AS (SELECT query_id, unnest(qt) AS term FROM q), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(ln((chunks - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (tokens / chunks)))), 9) AS score FROM po JOIN qs USING (term) JOIN df USING (term) CROSS JOIN tot GROUP BY ALL),
lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 40),
ca AS (SELECT query_id, chunk_id, 's' || (doc_id % 40) AS source_id, rank, 1 / (60.0 + rank) AS rrf, text, qt, doc_id, ordinal, CASE WHEN wh < ef THEN 'future' WHEN doc_id % 3 = 2 AND wh >= ef + to_hours(200) THEN 'inactive' WHEN wh >= TIMESTAMP '2024-02-10' AND doc_id % 11 <> 0 AND doc_id % 6 = 5 AND doc_id % 40 % 4 = 1 THEN 'inactive' ELSE 'active' END AS state
  FROM lex JOIN (SELECT *, TIMESTAMP '2024-01-01' + to_hours((doc_id % 1000)::BIGINT) AS ef FROM ix) USING (chunk_id) JOIN q USING (query_id)),
ok AS (SELECT * FROM ca WHERE doc_id % 40 % 9 <> 4 AND doc_id % 11 <> 0 AND state <> 'future'),
cu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE state WHEN 'active' THEN 0 ELSE 1 END, rrf DESC, chunk_id) AS place FROM ok WHERE rank <= 20), de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE state WHEN 'active' THEN 0 ELSE 1 END, rrf DESC, chunk_id) AS place FROM ok),
bs AS (SELECT query_id, source_id, count(*) AS n, max(place) AS last, min(place) AS first FROM cu GROUP BY ALL), dm AS (SELECT query_id, arg_max(last, n * 1000 - first) AS gone FROM bs GROUP BY 1 HAVING sum(n) >= 20 AND max(n) > 10),
nw AS (SELECT query_id, arg_min(chunk_id, place) AS fresh FROM de ANTI JOIN bs USING (query_id, source_id) GROUP BY 1),
po2 AS (SELECT cu.query_id, cu.place, CASE WHEN cu.place = gone AND fresh IS NOT NULL THEN fresh ELSE cu.chunk_id END AS chunk_id FROM cu LEFT JOIN dm USING (query_id) LEFT JOIN nw USING (query_id)),
ci AS (SELECT p.query_id, p.place, ca.* EXCLUDE (query_id) FROM po2 p JOIN ca USING (query_id, chunk_id) WHERE p.place <= 5),
nb AS (SELECT ci.query_id, ci.chunk_id AS hit, ck.ordinal, ck.text, coalesce(sum(length(ck.text)) OVER (PARTITION BY ci.query_id, ci.chunk_id ORDER BY CASE WHEN ck.ordinal = ci.ordinal THEN 0 ELSE 1 END, ck.ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ci JOIN ck ON ck.doc_id = ci.doc_id AND ck.ordinal BETWEEN ci.ordinal - 1 AND ci.ordinal + 1),
cx AS (SELECT query_id, hit, string_agg(substr(text, 1, (4000 - used)::BIGINT), chr(10) ORDER BY ordinal) AS context FROM nb WHERE used < 4000 GROUP BY ALL)"""
    r["knowledge_query"] = store + f" SELECT ci.query_id, place, ci.chunk_id, source_id, state AS temporal_state, round(rrf, 9) AS rrf, 1::BIGINT AS channels, round(len(list_intersect(qt, {terms('text')})) / greatest(1, len(qt))::DOUBLE, 9) AS term_coverage, sha256(context) AS context FROM ci JOIN cx ON cx.query_id = ci.query_id AND cx.hit = ci.chunk_id"
    r["knowledge_statuses"] = store + """, pe AS (SELECT query_id, count(*) FILTER (state = 'active') AS a, count(*) FILTER (state = 'inactive') AS i, count(DISTINCT CASE WHEN state = 'active' THEN source_id END) AS s FROM ci WHERE place <= 2 GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN pe.query_id IS NULL THEN 'no_authoritative_source' WHEN item_id % 4 = 3 OR item_id % 11 = 0 THEN 'insufficient_evidence' WHEN item_id % 5 = 0 AND s >= 2 THEN 'conflict' WHEN item_id % 5 = 0 THEN 'insufficient_evidence' WHEN a > 0 THEN 'grounded' WHEN i > 0 THEN 'outdated_only' ELSE 'insufficient_evidence' END AS answer_status FROM benchmark LEFT JOIN pe ON pe.query_id = item_id"""
    r["next_versions"] = rev + " SELECT source_id, max(version) + 1 AS next_version FROM ve GROUP BY 1"
    kinds = [f"{k}_at_{n}" for k in ("hit", "precision", "recall") for n in (1, 3, 5)] + ["r_precision", "mrr_at_5", "ndcg_at_5"]
    r["macro_metrics"] = f"SELECT query_id % 3 AS third, {', '.join(f'round(avg({k}), 9) AS {k}' for k in kinds)} FROM ({r['retrieval_metrics']}) GROUP BY 1"
    r["embedding_backlog"] = ch + """, rt AS (SELECT doc_id, 'Title: guide' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Heading: body' || chr(10) ELSE '' END || chr(10) || text AS t FROM ck)
SELECT DISTINCT sha256('title-heading-body-v1' || chr(10) || t) AS content_hash, length(t) AS chars FROM rt WHERE t NOT IN (SELECT t FROM rt WHERE doc_id % 4 = 0)"""
    r["undeclared_values"] = BASE + ", l AS (SELECT DISTINCT language AS key FROM m), g AS (SELECT unnest(['en', 'es', 'ar']) AS key) SELECT 'language_undeclared' AS rule, key FROM l WHERE key NOT IN (SELECT key FROM g) UNION ALL SELECT 'language_unobserved', key FROM g WHERE key NOT IN (SELECT key FROM l)"
    r["redacted_texts"] = "SELECT doc_id, sha256(regexp_replace(text || ' ' || sha256(text) || ' x' || sha256(text), '\\b[0-9a-fA-F]{64}\\b', '[REDACTED_HEX]', 'g')) AS text_sha256 FROM documents"
    r["metric_adapters"] = """WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS d, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus <> 'O') AS c FROM orders GROUP BY 1)
SELECT o_custkey, round(CASE WHEN c <> 0 THEN d / c::DOUBLE END, 9) AS ratio, CASE WHEN c = 0 THEN 'zero_denominator' ELSE 'observed' END AS reason, round(CASE WHEN c <> 0 THEN (d + 0.5 * p) / c::DOUBLE END, 9) AS coverage FROM o"""
    r["adapter_violations"] = "SELECT c_custkey, 'part' AS field, CASE WHEN c_custkey % 7 = 0 THEN 'not_finite' ELSE 'not_a_count' END AS problem FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 13 = 0"
    span = lambda k, a, z, y: f"SELECT community_id, count(*) FILTER (ts >= DATE '{z}') AS messages, count(*) FILTER (ts < DATE '{z}') AS baseline_messages, count(DISTINCT CASE WHEN ts >= DATE '{z}' THEN user_id_hash END) AS users, count(DISTINCT CASE WHEN ts < DATE '{z}' THEN user_id_hash END) AS baseline_users, '{k}' AS kind FROM m WHERE ts >= DATE '{a}' AND ts < DATE '{y}' GROUP BY 1"
    r["windows_of_all_kinds"] = BASE + " UNION ALL ".join(span(*x) for x in (("24h", "2024-01-02", "2024-01-03", "2024-01-04"), ("7d", "2024-01-01", "2024-01-08", "2024-01-15"), ("30d", "2023-12-02", "2024-01-01", "2024-01-31"), ("custom", "2023-12-28", "2024-01-03", "2024-01-09"), ("since_last_check", "2024-01-09", "2024-01-12", "2024-01-15")))
    r["answer_statuses"] = """SELECT item_id AS query_id, CASE WHEN item_id % 11 = 0 THEN 'insufficient_evidence' WHEN item_id % 5 = 0 THEN CASE WHEN item_id % 3 <> 0 THEN 'conflict' ELSE 'insufficient_evidence' END WHEN item_id % 7 = 0 THEN 'insufficient_evidence'
  WHEN item_id % 3 <> 0 THEN 'grounded' ELSE 'outdated_only' END AS answer_status FROM benchmark"""
    r["chat_pages"] = """WITH t AS (SELECT conv_id AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn::VARCHAR AS source_id, CASE WHEN turn % 3 <> 2 THEN role ELSE last_value(CASE WHEN turn % 3 <> 2 THEN role END IGNORE NULLS) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) END AS sender,
  TIMESTAMP '2024-02-01 09:00:00' + to_seconds(turn % 60) AS timestamp, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations) SELECT page, pos, source_id, sender, timestamp, sha256(x) AS text_sha256, NULL::VARCHAR AS reply_id FROM t WHERE x <> '' AND sender IS NOT NULL"""
    key = lambda c: f"""'tg_' || substr(sha256('{{"community":"community_import","message":"' || {c} || '"}}'), 1, 24)"""
    r["chat_import"] = f"""WITH k AS (SELECT conv_id, turn, turn + 1 AS id, CASE WHEN turn > 0 THEN turn END AS reply, text, 'user' || (conv_id % 7) || '_' || role AS sender, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS ts FROM conversations WHERE role <> 'system' AND trim(text) <> '')
SELECT {key('c.id')} AS message_id, 'community_import' AS community_id, 'en' AS language, 'usr_' || sha256('{{"community":"community_import","sender":"' || c.sender || '"}}') AS user_id_hash, 'user' AS user_role, c.ts AS timestamp, c.text, CASE WHEN p.id IS NOT NULL THEN {key('p.id')} END AS reply_to_message_id, NULL::VARCHAR AS campaign_id,
  CASE WHEN c.reply IS NOT NULL THEN {key('c.reply')} END AS reply_to_source_key FROM k c LEFT JOIN k p ON p.conv_id = c.conv_id AND p.id = c.reply"""
    r["report_languages"] = BASE + """, lc AS (SELECT scope, community_id, language, count(*) AS n FROM sc GROUP BY ALL), g AS (SELECT campaign_id AS scope_id, community_id FROM camp CROSS JOIN (SELECT DISTINCT community_id FROM m)),
a AS (SELECT scope, community_id, count(*) AS k, string_agg(language, ',' ORDER BY language) AS l, string_agg(language || '=' || n, ',' ORDER BY language) AS d FROM lc GROUP BY ALL)
SELECT g.scope_id, g.community_id, CASE WHEN k IS NULL THEN 'no_observation' WHEN k = 1 THEN l ELSE 'multilingual:' || l END AS language_scope, coalesce(d, '') AS distribution FROM g LEFT JOIN a ON a.scope = g.scope_id AND a.community_id = g.community_id"""
    evid = lambda m, c: f"""'evidence_' || substr(sha256('["source_message",null,"' || {c} || '","' || {m} || '"]'), 1, 24)"""
    r["report_hygiene"] = BASE + f""", h AS (SELECT community_id, message_id, norm, ts, 'usr_' || (conv_id % 2) AS u FROM m), filler AS (SELECT community_id, message_id FROM h WHERE norm IN ({', '.join(map(quote, t.FILLER_TERMS))}) OR length(norm) <= 3),
same AS (SELECT community_id, message_id FROM h QUALIFY count(*) OVER (PARTITION BY community_id, norm) >= 2), again AS (SELECT community_id, message_id FROM h QUALIFY count(*) OVER (PARTITION BY community_id, u, norm) >= 3),
quick AS (SELECT DISTINCT b.community_id, b.message_id FROM h e JOIN h b ON b.community_id = e.community_id AND b.u = e.u AND b.ts <= e.ts AND b.ts >= e.ts - INTERVAL 60 SECOND WHERE (SELECT count(*) FROM h w WHERE w.community_id = e.community_id AND w.u = e.u AND w.ts <= e.ts AND w.ts >= e.ts - INTERVAL 60 SECOND) >= 3),
ev AS (SELECT community_id, string_agg(e, ',' ORDER BY e) AS s, count(*) AS n FROM (SELECT DISTINCT community_id, {evid('message_id', 'community_id')} AS e FROM (SELECT * FROM filler UNION SELECT * FROM same UNION SELECT * FROM again UNION SELECT * FROM quick)) GROUP BY 1),
ct AS (SELECT community_id, norm, u, count(*) AS n FROM h GROUP BY ALL), cn AS (SELECT community_id, norm, sum(n) AS n, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS rp FROM ct GROUP BY ALL)
SELECT community_id, sum(cn.n)::BIGINT AS message_count, round(sum(cn.n - 1) / sum(cn.n)::DOUBLE, 9) AS duplicate_ratio, round(sum(CASE WHEN norm IN ({', '.join(map(quote, t.FILLER_TERMS))}) OR length(norm) <= 3 THEN cn.n ELSE 0 END) / sum(cn.n)::DOUBLE, 9) AS filler_ratio, round(sum(rp) / sum(cn.n)::DOUBLE, 9) AS repetitive_content_ratio,
  coalesce(any_value(ev.n), 0) AS n_evidence, sha256(coalesce(any_value(s), '')) AS evidence_sha256 FROM cn LEFT JOIN ev USING (community_id) GROUP BY 1"""
    r["report_feedback"] = _labels() + f""", fe AS (SELECT behavior, message_id AS one, community_id FROM lab UNION SELECT behavior, parent, community_id FROM lab WHERE behavior IN ('question_answering', 'peer_support') UNION SELECT behavior, prior_id, community_id FROM lab WHERE behavior = 'duplicate_promotion'),
ev AS (SELECT behavior, string_agg(e, ',' ORDER BY e) AS s, count(*) AS n FROM (SELECT DISTINCT behavior, {evid('one', 'community_id')} AS e FROM fe) GROUP BY 1), ct AS (SELECT behavior, count(*) AS k FROM lab GROUP BY 1)
SELECT f.behavior, coalesce(k, 0) AS message_count, CASE WHEN k > 0 THEN 'Observed' ELSE 'Not observed in this dataset' END AS observation_status, coalesce(n, 0) AS n_evidence, sha256(coalesce(s, '')) AS evidence_sha256 FROM (SELECT unnest([{', '.join(map(quote, b.FEEDBACK_LABELS))}]) AS behavior) f LEFT JOIN ct USING (behavior) LEFT JOIN ev USING (behavior)"""
    return r
