import datetime as dt
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.functions import text
from threadloom.functions.vectors import cosine
from threadloom.operators import activation, behavior, campaign, evaluation, hygiene, knowledge, metrics, retrieval, threads, validation, workspace

T0 = dt.datetime(2026, 9, 1)


def messages(spark, rows):
    """rows of (id, seconds, role, user, text, reply[, campaign])"""
    full = [(i, "c", "en", u, r, T0 + dt.timedelta(seconds=s), t, p, *(rest or [None])) for i, s, r, u, t, p, *rest in rows]
    return spark.createDataFrame(full, schema.MESSAGES)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_normal_form_matches_column(spark):
    values = ["  Hello\t World ", "ＦＵＬＬ　width", "Straße", "", None, "a\x1cb", "ﬁne Ⅷ"]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", text.normalize(F.col("t")).alias("n"))
    assert {r.i: r.n for r in out.collect()} == {i: None if v is None else text.normal_form(v) for i, v in enumerate(values)}


def test_duplicates_and_filler(spark):
    m = messages(spark, [("m1", 0, "user", "usr_1", "Synthetic update", None), ("m2", 1, "user", "usr_2", "ＳＹＮＴＨＥＴＩＣ   ＵＰＤＡＴＥ", None), ("m3", 2, "user", "usr_3", "synthetic update", None), ("m4", 3, "user", "usr_1", "ok", None)])
    r = hygiene.content_ratios(m).first()
    assert (r.duplicate_ratio, r.filler_ratio, r.repetitive_content_ratio) == (0.5, 0.25, 0.0)
    assert got(hygiene.duplicate_members(m), "message_id") == [("m1",), ("m2",), ("m3",)]
    assert hygiene.content_ratios(m.limit(0)).count() == 0


@pytest.mark.parametrize(("times", "expected"), [((0, 30, 55, 121), [["m0", "m1", "m2"]]), ((0, 30, 55, 70), [["m0", "m1", "m2"], ["m1", "m2", "m3"]]), ((0, 100, 200), [])])
def test_bursts(spark, times, expected):
    m = messages(spark, [(f"m{k}", s, "user", "usr_1", "x", None) for k, s in enumerate(times)])
    assert sorted(r.message_ids for r in hygiene.bursts(m).collect()) == expected


def test_bursts_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{k:03d}", int(rng.integers(0, 400)), "user", f"usr_{rng.integers(0, 3)}", "x", None) for k in range(90)]
    want = set()
    for u in {r[3] for r in rows}:
        mine = sorted((s, i) for i, s, _, v, *_ in rows if v == u)
        wins = {tuple(i for s, i in mine[a : b + 1]) for a in range(len(mine)) for b in range(a, len(mine)) if mine[b][0] - mine[a][0] <= 60 and b - a >= 2}
        want |= {w for w in wins if not any(set(w) < set(v) for v in wins)}
    assert {tuple(r.message_ids) for r in hygiene.bursts(messages(spark, rows)).collect()} == want


CHAIN = [("m1", 0, "moderator", "usr_a", "hello all", None), ("m2", 10, "user", "usr_1", "how does it work?", "m1"), ("m3", 30, "moderator", "usr_a", "it works like this", "m2"), ("m4", 50, "user", "usr_2", "thanks a lot", "m3")]


def test_answered_chain(spark):
    m = messages(spark, CHAIN)
    e = threads.episodes(m).first()
    assert (e.conversation_depth, e.branching_factor, e.participants, e.first_response_seconds, e.duration_seconds, e.moderator_replies) == (4, 1.0, 3, 10.0, 50.0, 1)
    assert got(threads.candidate_answers(m), "question_id", "answer_id") == [("m2", "m3")]
    assert [tuple(r) for r in threads.question_support(m).collect()] == [("c", 1, 0, 1, 0)]


def test_clarifications(spark):
    a = messages(spark, [("m1", 0, "user", "usr_1", "what now?", None), ("m2", 1, "user", "usr_2", "what do you mean?", "m1"), ("m3", 2, "user", "usr_3", "press this", "m2")])
    assert got(threads.candidate_answers(a), "question_id", "answer_id") == [("m1", "m3"), ("m2", "m3")]
    b = messages(spark, [("m1", 0, "user", "usr_1", "what now?", None), ("m2", 1, "moderator", "usr_a", "which one?", "m1"), ("m3", 2, "user", "usr_1", "the first", "m2"), ("m4", 3, "moderator", "usr_a", "press it", "m3")])
    assert ("m1", "m4") in got(threads.candidate_answers(b), "question_id", "answer_id")
    c = messages(spark, [("m1", 0, "user", "usr_1", "what now?", None), ("m2", 1, "bot", "usr_b", "beep", "m1"), ("m3", 2, "user", "usr_2", "this", "m2")])
    assert threads.candidate_answers(c).count() == 0


def test_branching_and_order(spark):
    m = messages(spark, [("m1", 0, "user", "usr_1", "a", None), ("m2", 1, "user", "usr_2", "b", "m1"), ("m3", 2, "user", "usr_3", "c", "m1"), ("m4", 3, "user", "usr_1", "d", "m2"), ("m5", 4, "user", "usr_1", "alone", "gone")])
    want = {"m1": (3, 1.5), "m5": (1, 0.0)}
    for rows in (m, m.orderBy(F.desc("message_id")).repartition(3)):
        assert {r.root_id: (r.conversation_depth, r.branching_factor) for r in threads.episodes(rows).collect()} == want


def test_deep_thread_and_cycle(spark):
    m = messages(spark, [(f"m{k:03d}", k, "user", "usr_1", "x", f"m{k - 1:03d}" if k else None) for k in range(150)] + [("z1", 0, "user", "usr_1", "x", "z2"), ("z2", 0, "user", "usr_1", "x", "z1")])
    r = {x.message_id: (x.root_id, x.depth) for x in threads.roots(m).collect()}
    assert r["m149"] == ("m000", 150) and "z1" not in r and len(r) == 150
    assert ("cycle", "z1") in got(validation.message_rules(m), "rule", "key")


def test_latency_and_ratios(spark):
    m = messages(spark, [("m1", 0, "user", "usr_1", "a question of mine", None), ("m2", 20, "moderator", "usr_a", "x", "m1"), ("m2b", 25, "moderator", "usr_a", "y", "m1"), ("m3", 30, "user", "usr_2", "another one here", None), ("m4", 70, "moderator", "usr_a", "z", "m3")])
    assert got(activation.first_replies(m), "message_id", "reply_id", "latency_seconds") == [("m1", "m2", 20.0), ("m3", "m4", 40.0)]
    a = activation.activation(m).first()
    assert (a.response_latency_seconds, a.responses, a.user_to_user_interaction_ratio) == (30.0, 2, 0.0)
    b = activation.activation(messages(spark, [("m1", 0, "user", "usr_1", "what?", None), ("m2", 1, "user", "usr_1", "me again", "m1"), ("m3", 2, "user", "usr_2", "this way", "m1")])).first()
    assert (b.self_reply_count, b.user_to_user_interaction_ratio, b.peer_support_edge_ratio) == (1, 1 / 3, 1.0)


def test_violations(spark):
    rows = [("m1", 5, "user", "usr_1", "a", None), ("m1", 6, "user", "usr_1", "a", None), ("m2", 1, "user", "usr_1", "b", "m3"), ("m3", 9, "owner", "bad", " ", "nowhere"), ("m4", 9, "user", "usr_1", "x", "m4")]
    rules = {r for r, _ in got(validation.message_rules(messages(spark, rows)), "rule", "key")}
    assert {"duplicate_message_id", "missing_parent", "unknown_role", "malformed_user_id", "blank_text", "reply_before_parent", "self_reply", "cycle"} <= rules


@pytest.mark.parametrize(("role", "words", "label"), [
    ("moderator", "ok", "filler"), ("moderator", "see https://a.b and http://c.d", "spam"), ("moderator", "how is it going?", "conversation_initiation"), ("moderator", "Actually it is Friday", "misinformation_correction"),
    ("moderator", "Welcome new members", "user_onboarding"), ("moderator", "Stake now", "CTA"), ("moderator", "大家好", "normal_chat"), ("user", "how does the wallet connect", "product_question"), ("user", "this is a scam", "FUD"),
    ("user", "this is not a scam", "unclassified"), ("user", "it looks like a fraud", "FUD"), ("user", "please add a button", "feature_request"), ("user", "never really that broken", "unclassified"), ("user", "it is broken", "complaint"),
    ("user", "the guide is unclear", "negative_feedback"), ("user", "clear and useful", "positive_feedback"), ("user", "I joined", "CTA_response"), ("user", "weather today", "off_topic"), ("user", "https://a.b", "external_information_sharing"),
    ("user", "will buy soon", "purchase_or_usage_intent"), ("user", "project roadmap", "project_discussion"), ("bot", "this is a scam", "unclassified"),
])
def test_labels(spark, role, words, label):
    assert behavior.seed_behaviors(messages(spark, [("m1", 0, role, "usr_1", words, None)])).first().behavior == label


def test_duplicate_promotion(spark):
    m = messages(spark, [("m1", 0, "moderator", "usr_a", "Join us", None), ("m2", 10, "moderator", "usr_a", "join  us", None), ("m3", 20, "moderator", "usr_a", "join us", None, "x"), ("m4", 4000, "moderator", "usr_a", "join us", None)])
    assert got(behavior.duplicate_promotions(m), "message_id", "prior_id") == [("m2", "m1")]
    assert got(behavior.feedback_counts(behavior.seed_behaviors(m)), "message_count") == [(0,)] * 5


def test_claims(spark):
    p = spark.createDataFrame([("q1", "x", "covered", "100 tokens"), ("q1", "x", "incorrect", "0 tokens"), ("q2", "x", "partially_covered", "soon"), ("q3", "x", "covered", "never said"), ("q4", "x", "covered", "yes"), ("q4", "x", "incorrect", "nay")], "claim_id string, campaign_id string, status string, pattern string")
    m = threads.with_question(messages(spark, [("m1", 0, "user", "usr_1", "get 100 tokens soon", None, "x"), ("m2", 1, "user", "usr_1", "yes", None, "x"), ("m3", 1, "user", "usr_1", "nay", None, "x")]))
    j = campaign.judgments(campaign.claim_matches(m, p), p.select("campaign_id", "claim_id").distinct(), m)
    assert got(j, "claim_id", "status", "match_strength") == [("q1", "covered", 1.0), ("q2", "partially_covered", 0.6), ("q3", "not_covered", 0.0), ("q4", "uncertain", 0.5)]
    s = campaign.summary(j).first()
    assert (s.semantic_coverage, s.claim_completeness, s.warning_count, s.semantic_drift_count) == (1.5 / 4, 0.25, 1, 0)


def test_metric_census(spark):
    raw = [None, "bad", "Infinity", "-Infinity", "1", "2", "3", "4", "5"]
    q = metrics.quality(spark.createDataFrame([("m", r) for r in raw], "metric_name string, raw string")).first()
    assert (q.raw_missing_count, q.invalid_nonnumeric_count, q.positive_infinity_count, q.negative_infinity_count, q.finite_count, q.mean, q.variance) == (1, 1, 1, 1, 5, 3.0, 2.0)


@pytest.mark.parametrize(("n", "p"), [(3, 2 / 6), (4, 2 / 24), (5, 2 / 120), (9, None), (20, 1e-300)])
def test_inference(spark, n, p):
    a = metrics.associations(spark.createDataFrame([("k", float(i), float(i * i)) for i in range(n)], "k string, x double, y double"), ["k"]).first()
    assert a.n == n and abs(a.rho - 1) < 1e-12
    assert a.raw_p is None if p is None else abs(a.raw_p - p) < 1e-9


def test_student_tail():
    assert abs(metrics.student_two_sided(2.0, 10) - 0.07338803477074039) < 1e-10
    assert abs(metrics.student_two_sided(0.5, 3) - 0.6514479648481434) < 1e-9


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, raw_p double")
    assert {r.k: r.adjusted_p and round(r.adjusted_p, 9) for r in metrics.holm(t, ["k"]).collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": None}


def test_roles_by_interval_and_version(spark):
    m = messages(spark, [("m1", 0, "user", "usr_1", "x", None), ("m2", 100, "user", "usr_1", "x", None), ("m3", 300, "user", "usr_1", "x", None)])
    t = lambda s: T0 + dt.timedelta(seconds=s)
    a = spark.createDataFrame([("usr_1", "moderator", t(50), None, 1), ("usr_1", "bot", t(90), t(200), 2)], "user_id_hash string, role string, valid_from timestamp, valid_to timestamp, version int")
    assert got(workspace.resolve_roles(m, a), "message_id", "resolved_role") == [("m1", "user"), ("m2", "bot"), ("m3", "moderator")]


def test_windows():
    end = dt.datetime(2026, 1, 2)
    w = workspace.resolve_window("since_last_check", end)
    assert w["fallback_used"] and w["baseline_start"] == dt.datetime(2025, 12, 31)
    assert workspace.resolve_window("since_last_check", end, checked_through=dt.datetime(2026, 1, 1, 20))["start"].hour == 20
    for bad in ("1y", "custom"):
        with pytest.raises(ValueError):
            workspace.resolve_window(bad, end)


def test_imports_in_either_order(spark):
    s = "message_id string, reply_to_message_id string, reply_to_source_key string"
    child, parent = spark.createDataFrame([("b", None, "a")], s), spark.createDataFrame([("a", None, None)], s)
    for first, second in ((child, parent), (parent, child)):
        both = workspace.insert_or_ignore(first, second.union(first))
        assert got(workspace.resolve_late_replies(both).where("message_id = 'b'"), "reply_to_message_id") == [("a",)]


def test_chunks(spark):
    body = "# One\n\nWhat is it?\n\nThis.\n\n## Two\n\n[Page 3] " + " ".join(map(str, range(400))) + "\n\n### Three\n\nx\n\n## Four\n\nA what?\n\nB what?\n\nC what?\n\nanswer\n\nD what?\n\n# One\n\ny"
    rows = [(1, "faq", body), (2, "faq", ""), (3, "whitepaper", "Why?\n\n \n\nfor this\n"), (4, "faq", "# Only a head"), (5, None, None)]
    c = defaultdict(list)
    for r in knowledge.chunk(spark.createDataFrame(rows, "revision_id int, source_type string, content string")).orderBy("revision_id", "ordinal").collect():
        c[r.revision_id].append(r)
    assert [(x["section"], x["parent_heading"]) for x in c[1][:2]] == [("One", "One"), ("Two", "One > Two")] and [x.ordinal for x in c[1]] == list(range(len(c[1])))
    assert c[1][0]["text"] == "What is it?\n\nThis." and c[1][1]["page"] == 3 and [x["token_count"] for x in c[1][1:4]] == [180, 180, 102]
    # of three questions in a row the second is the first one's answer; the last has none
    assert [(x.parent_heading, x.text) for x in c[1][4:]] == [("One > Two > Three", "x"), ("One > Four", "A what?\n\nB what?"), ("One > Four", "C what?\n\nanswer"), ("One > Four", "D what?"), ("One", "y")]
    assert [(x.text, x.token_count, x.section) for x in c[2]] == [("", 0, None)] and [x.text for x in c[3]] == ["Why?", "for this"] and [(x.text, x.section) for x in c[4]] == [("# Only a head", "Only a head")] and [x.text for x in c[5]] == [""]


def test_temporal_and_policy(spark):
    s = "query_id int, chunk_id string, source_id string, rrf double, channels int, official_status string, status string, temporal_state string"
    row = lambda i, r, ch, st: (1, i, "s", r, ch, "verified_official", "current", st)
    first = knowledge.select_candidates(spark.createDataFrame([row("old", 0.03, 2, "inactive"), row("new", 0.02, 2, "active")], s), 5)
    assert [x[0] for x in sorted(got(first, "chunk_id", "place"), key=lambda x: x[1])] == ["old", "new"]
    plain = knowledge.select_candidates(spark.createDataFrame([row("old", 0.03, 1, "inactive"), row("new", 0.02, 2, "active"), row("b", 0.02, 2, "active"), row("f", 1.0, 2, "future")], s), 5)
    assert [x[0] for x in sorted(got(plain, "chunk_id", "place"), key=lambda x: x[1])] == ["b", "new", "old"]


def test_diversity(spark):
    rows = [(1, f"a{k:02d}", "a", k + 1) for k in range(12)] + [(1, f"b{k}", "b", k + 13) for k in range(8)]
    s = "query_id int, chunk_id string, source_id string, place int"
    deep = spark.createDataFrame([*rows, (1, "c0", "c", 21)], s)
    out = {r.place: r.chunk_id for r in knowledge.diversify(spark.createDataFrame(rows, s), deep, 20).collect()}
    assert out[12] == "c0" and len(out) == 20
    even = [(1, f"x{k}", "a" if k < 10 else "b", k + 1) for k in range(20)]
    assert got(knowledge.diversify(spark.createDataFrame(even, s), deep, 20), "chunk_id") == sorted((r[1],) for r in even)


def test_retrieval_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, target string")
    ranked = spark.createDataFrame([(q, t, i) for q in (1, 2) for i, t in enumerate("xabyz", 1)] + [(1, "x", 9)], "query_id int, target string, rank int")
    r = {x.query_id: x for x in evaluation.retrieval_metrics(gold, ranked).collect()}
    assert (r[1].hit_at_1, r[1].hit_at_3, round(r[1].precision_at_3, 6), r[1].recall_at_3, r[1].r_precision, r[1].mrr_at_5) == (0, 1, 0.666667, 1.0, 0.5, 0.5)
    assert all(v is None for k, v in r[2].asDict().items() if k != "query_id")


def test_terms_and_vectors(spark):
    r = spark.createDataFrame([("The wallets of 钱包功能 wallet Straße class",)], "t string").select(text.search_terms(F.col("t")).alias("x")).first()
    assert r.x == ["wallet", "钱包功能", "strasse", "clas", "钱包", "包功", "功能"]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(v[0].c - 0.5**0.5) < 1e-12 and v[1].c is None


def test_answer_status(spark):
    need = spark.createDataFrame([(1, "r", "supported"), (2, "r", "supported"), (3, "r", "conflict"), (4, "r", "supported"), (5, "r", "supported")], "query_id int, requirement_id string, status string")
    claims = spark.createDataFrame([(1, "r", "a", "active", True), (2, "r", "a", "inactive", True), (3, "r", "a", "active", True), (3, "r", "b", "active", True), (4, "r", "a", "active", False)], "query_id int, requirement_id string, source_id string, temporal_state string, found boolean")
    assert dict(got(knowledge.answer_status(need, claims), "query_id", "answer_status")) == {1: "grounded", 2: "outdated_only", 3: "conflict", 4: "insufficient_evidence", 5: "insufficient_evidence"}


def test_cycles_of_every_length(spark):
    """Messages on circles of replies, and those below them, reach no root; other threads do, however deep."""
    sizes = (1, 2, 3, 5, 7)
    rows = [(f"c{n}_{i}", f"c{n}_{(i + 1) % n}") for n in sizes for i in range(n)] + [(f"t{n}", f"c{n}_0") for n in sizes] + [(f"u{n}", f"t{n}") for n in sizes]
    circles = {a for a, _ in rows}
    rows += [("r", None)] + [(f"d{i}", f"d{i - 1}" if i else "r") for i in range(12)]
    m = spark.createDataFrame([(a, "g", "en", "usr_1", "user", T0, "text", b, None) for a, b in rows], schema.MESSAGES)
    got = {r.message_id: r.depth for r in threads.roots(m).collect()}
    assert got == {"r": 1, **{f"d{i}": i + 2 for i in range(12)}}
    assert {r.key for r in validation.message_rules(m).where("rule = 'cycle'").collect()} == circles


def _series(spark, n, **more):
    frame = spark.createDataFrame([(f"o{i:02}", float(i), float(i * i % 7)) for i in range(n)], "observation_id string, up double, other double")
    outcomes = spark.createDataFrame([(f"o{i:02}", float(i * 2), float(-i)) for i in range(n)], "observation_id string, a double, b double")
    return metrics.validate_metrics(frame, outcomes, ["observation_id"], ["up", "other"], ["a", "b"], **more)


def test_metrics_against_outcomes(spark):
    # exact up to 8 pairs, none up to 19, asymptotic beyond; the family counts every test
    for n, p, status in ((5, 2 / 120, "Candidate"), (9, None, "Candidate"), (20, 1e-300, "Promising")):
        statuses, tests = _series(spark, n)
        got = {(r.metric_name, r.outcome_name): r for r in tests.collect()}
        assert len(got) == 4
        up = got["up", "a"]
        assert abs(abs(up.rho) - 1) < 1e-9 and (up.raw_p is None if p is None else abs(up.raw_p - p) < 1e-9)
        if n == 5:
            assert abs(up.adjusted_p - 4 * 2 / 120) < 1e-9
        assert {r.metric_name: r.status for r in statuses.collect()}["up"] == status
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "observation_id string, up double")
    other = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "observation_id string, y double")
    with pytest.raises(ValueError, match="1 of metrics only, 1 of outcomes only"):
        metrics.validate_metrics(frame, other, ["observation_id"], ["up"], ["y"])
    with pytest.raises(ValueError, match="unique"):
        metrics.validate_metrics(frame.union(frame), other, ["observation_id"], ["up"], ["y"])
    alone, none = metrics.validate_metrics(frame, None, ["observation_id"], ["up"], [])
    assert not none.count() and alone.first().reasons == ["insufficient_sample", "no_outcome_frame"]


def test_ranks_of_many_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 40, 400), strict=True)]
    got = metrics.average_ranks(spark.createDataFrame(rows, "g int, v double"), "v", ["g"], "r").toPandas()
    want = got.groupby("g")["v"].rank()
    assert np.allclose(got["r"], want) and len(got) == 400


def test_revisions_end_their_predecessors(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    none = spark.createDataFrame([], "source_id string, version long, content_hash string, status string, effective_from timestamp, superseded_at timestamp")
    come = lambda *rows: spark.createDataFrame(list(rows), "source_id string, content string, status string, effective_from timestamp, arrived long")
    first = knowledge.add_revisions(none, come(("s", "A", "current", at(1), 1), ("s", "A", "current", at(2), 2)))
    assert [(r.version, r.status, r.superseded_at) for r in first.collect()] == [(1, "current", None)]
    second = knowledge.add_revisions(first, come(("s", "A", "current", at(3), 3), ("s", "B", "current", at(4), 4), ("s", "A", "current", at(5), 5)))
    assert sorted((r.version, r.status, r.superseded_at) for r in second.collect()) == [(1, "superseded", at(4)), (2, "current", None)]


def test_retrieval_and_reranking(spark):
    now = dt.datetime(2024, 3, 1)
    sources = spark.createDataFrame([(f"s{i}", f"title {i}", "verified_official" if i != 2 else "community", "{}") for i in range(4)], "source_id string, title string, official_status string, metadata_provenance string")
    revisions = spark.createDataFrame(
        [(f"r{i}", f"s{i}", "draft" if i == 3 else "current", None, dt.datetime(2024, 1 if i != 1 else 6, 1), None, None) for i in range(4)],
        "revision_id string, source_id string, status string, published_at timestamp, effective_from timestamp, effective_until timestamp, superseded_at timestamp",
    )
    chunks = spark.createDataFrame([(f"r{i}:{k}", f"r{i}", None, None, k, f"staking rewards part {k} of {i} " + ("reward " * k)) for i in range(4) for k in range(3)], "chunk_id string, revision_id string, section string, parent_heading string, ordinal int, text string")
    asked = spark.createDataFrame([("q", "how do staking rewards work?", None), ("later", "staking", dt.datetime(2024, 7, 1)), ("none", "unheard of", None), ("blank", "  ", None)], "query_id string, query string, as_of_time timestamp")
    got = retrieval.retrieve(asked, sources, revisions, chunks, now, top_k=3)
    rows = {(r.query_id, r.chunk_id): r for r in got.collect()}
    # drafts, other people's and future revisions are not cited; a hit has its neighbours with it
    assert {c for q, c in rows if q == "q"} == {"r0:0", "r0:1", "r0:2"} and {c[:2] for q, c in rows if q == "later"} <= {"r0", "r1"}
    assert rows["q", "r0:1"].context.count("\n") == 2 and rows["q", "r0:1"].term_coverage > 0.5
    told = {r.query_id: r.answer_status for r in retrieval.statuses(asked, got).collect()}
    assert told == {"q": "insufficient_evidence", "later": "insufficient_evidence", "none": "no_authoritative_source", "blank": "no_authoritative_source"}
    turned = lambda pool: pool.select("query_id", "chunk_id", (-F.col("place")).alias("place"))
    again = retrieval.retrieve(asked, sources, revisions, chunks, now, top_k=3, rank=turned)
    first = {r.chunk_id: r.place for r in again.where("query_id = 'q'").collect()}
    assert [first[c] for c in sorted(first, key=lambda c: rows["q", c].place)] == [3, 2, 1] and all(r.reranked for r in again.collect())
    short = retrieval.retrieve(asked, sources, revisions, chunks, now, top_k=3, rank=lambda pool: turned(pool).where("chunk_id <> 'r0:0'"))
    assert {r.chunk_id: r.place for r in short.where("query_id = 'q'").collect()} == {c: rows["q", c].place for q, c in rows if q == "q"}
    with pytest.raises(ValueError):
        retrieval.retrieve(asked, sources, revisions, chunks, now, top_k=21)


def test_reindex_refuses_what_changed(spark):
    text = "# Head\n\nbody of the text"
    revisions = spark.createDataFrame([("a", "faq", text, "v1"), ("b", "faq", text, "v1"), ("c", "faq", text, "v2")], "revision_id string, source_type string, content string, index_version string").withColumn("content_hash", F.sha2(F.when(F.col("revision_id") == "b", "other").otherwise(F.col("content")), 256))
    stored = knowledge.chunk(revisions)
    good, refused = knowledge.reindexable(revisions, stored, "v2")
    assert [r.revision_id for r in good.collect()] == ["a"] and [(r.revision_id, r.problem) for r in refused.collect()] == [("b", "content_hash_mismatch")]
    good, refused = knowledge.reindexable(revisions, stored.withColumn("text", F.lit("moved")), "v2")
    assert not good.count() and {r.problem for r in refused.collect()} == {"content_hash_mismatch", "chunks_changed"}


def test_containing(spark):
    texts = spark.createDataFrame([(1, "a long tale of many words"), (2, "xa long tale ofx"), (3, None), (4, "tale")], "target long, body string")
    items = spark.createDataFrame([(10, "a long tale of"), (11, "tale"), (12, None), (13, "long tale of many")], "query_id long, text string")
    assert {(r.query_id, r.target) for r in evaluation.containing(texts, items).collect()} == {(10, 1), (10, 2), (11, 1), (11, 2), (11, 4), (13, 1)}
