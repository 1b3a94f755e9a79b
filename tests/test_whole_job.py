"""Queries over small tables of their own, whose rows lie where a query must not stop short."""

import math
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.functions import ngrams
from threadloom.functions.text import normal_form
from threadloom.llm import license_scan, quality
from threadloom.operators import clusters, profile
from threadloom.plans import oracles, queries
from threadloom.sources import conversations as src


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Makes a folder of tables, each given as rows and a schema."""

    def made(**given):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
        return path

    return made


TURNS = "conv_id long, turn int, role string, text string"


def test_behavior_clusters_take_all_messages_texts_and_starts(spark, tables, monkeypatch):
    # the first 200 characters are equal, so only what comes after them tells two kinds apart
    turns = [(c, t, "user", "same " * 50 + ("zzzz " if c % 2 else "qqqq ") * 40) for c in range(1, 7) for t in range(4)]
    starts = []

    class Counted(clusters.KMeans):
        def fit(self, *args):
            starts.append(self.getSeed())
            return super().fit(*args)

    monkeypatch.setattr(clusters, "KMeans", Counted)
    out = queries.behavior_clusters(spark, tables(conversations=(turns, TURNS))).collect()
    assert sum(r.message_count for r in out) == len(turns)
    assert any("zz" in t for r in out for t in r.top_terms)
    assert len(set(starts)) == 10


def test_licenses_in_ordinary_prose():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    prose = "The committee met on Tuesday to weigh the plans for a new bridge over the river, and heard from engineers who had surveyed both banks in spring. " * 3
    for name, notice in license_scan.TEMPLATES.items():
        for n in (20, 100, 350):
            for text in (f"{prose[:n]} {notice} {prose[:n]}", f"{prose[:n]}\n{notice.replace(' ', chr(10), 3)} {prose[:n]}"):
                assert name in {x["license"] for x in scanner.scan(text) if x["confirmed"]}, (name, n)
    both = scanner.scan(f"{prose} Released under the MIT License. Licensed under CC BY-SA 4.0. {prose}")
    assert {x["license"] for x in both if x["confirmed"]} == {"MIT", "CC-BY-SA-4.0"}
    assert [(x["line"], x["first_word"]) for x in scanner.scan("one\ntwo three All rights reserved. four")] == [(1, 2)]
    assert not [x for x in scanner.scan(f"{prose} the license plate, with permission {prose}") if x["confirmed"]]
    gpl = scanner.scan(f"{prose} {license_scan.TEMPLATES['GPL-3.0']} {prose} {license_scan.TEMPLATES['LGPL-3.0']}")
    assert [x["license"] for x in gpl if x["confirmed"]] == ["GPL-3.0", "LGPL-3.0"]


def test_quote_check_takes_all_pairs_and_whole_texts(spark, tables):
    quote = "a quote of rather more than forty characters, to its end"
    docs = [(1, f"before {quote} after"), (2, quote.replace(" ", " \n")), (3, quote[:-1]), (4, None), (45, "short")]
    items = [(7, quote), (8, "short"), (9, " "), (10, None)]
    out = queries.quote_check(spark, tables(documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))).collect()
    assert len(out) == len(docs) * len(items)
    assert sorted((r.item_id, r.doc_id) for r in out if r.found) == [(7, 1), (7, 2), (8, 45)]


def test_chat_pages_of_every_conversation(spark, tables):
    turns = [(c, t, "user", "hello") for c in (0, 49, 50, 7000) for t in range(2)]
    out = queries.chat_pages(spark, tables(conversations=(turns, TURNS))).collect()
    assert sorted((r.page, r.pos) for r in out) == sorted((c, p) for c in (0, 49, 50, 7000) for p in sorted({r.pos for r in out})) and len(out) == 8


def test_freshness_takes_all_messages_to_the_clock(spark, tables):
    # conversation 39 is the latest of g3; 65 is g1's, on 3 January; 200 comes after the clock
    turns = [(c, 0, "user", "x") for c in (3, 39, 5, 65, 200)]
    out = {r.community_id: (r.latest_message_at and (r.latest_message_at.day, r.latest_message_at.hour), r.status) for r in queries.freshness(spark, tables(conversations=(turns, TURNS))).collect()}
    assert out == {"g0": (None, "no_data"), "g1": ((3, 17), "stale"), "g2": (None, "no_data"), "g3": ((2, 15), "stale"), "g9": (None, "no_data")}


def test_neighbor_context_of_every_chunk(spark, tables):
    path = tables(documents=([(1, " ".join(f"w{i}" for i in range(500))), (2, "short")], "doc_id long, text string"))
    chunks = {(r.doc_id, r.ordinal) for r in queries.window_chunks(spark, path).collect()}
    out = queries.neighbor_context(spark, path).collect()
    assert {(r.doc_id, r.hit_ordinal) for r in out} == chunks and len(chunks) > 3


def test_longest_run_of_a_text_of_over_a_million_words(spark):
    text = F.concat(F.repeat(F.lit("a b "), 500_001), F.repeat(F.lit("c "), 9))
    assert spark.range(1).select(quality.statistics(text)["longest_run"]).first()[0] == 9


def test_tfidf_weights_count_over_all_messages(spark, tables):
    turns = [(c, t, "user", f"text {c} {'ab' * (t + 1)}") for c in (1, 9, 10, 12) for t in range(2)]
    path = tables(conversations=(turns, TURNS))
    texts = {r.message_id: normal_form(r.text) for r in src.messages(spark, path).collect()}
    grams = {k: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for k, t in texts.items()}
    df = Counter(g for x in grams.values() for g in x)
    want = {}
    for k, x in grams.items():
        w = [(1 + math.log(tf)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, tf in x.items()]
        want[k] = (len(w), pytest.approx(sum(w) / math.sqrt(sum(v * v for v in w)), abs=1e-5))
    assert {r.message_id: (r.terms, r.weight_sum) for r in queries.tfidf_weights(spark, path).collect()} == want


def by_sql(name, path, *names):
    """A query's rows by its SQL in DuckDB."""
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for n in names:
            c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}/{n}.parquet/*.parquet')")
        return c.execute(oracles.oracle_sql()[name]).fetchall()


def test_candidate_kinds_of_words_beside_letters_and_marks(spark, tables):
    words = ["how", "use", "sec", "lost", "lock", "buy on"]
    around = ["{}", "é{}", "{}é", "e\u0301{}", "{}\u0301", "好{}好", "²{}", "{}\u200d", "_{}", "{}9", "x {}’s"]
    odd = ["loc\u212a", "\u017fcam", "a\u017fcam", "li\u0307nk", "l\u0131nk", "LİNK", "a\u0301 b\u0301 c\u0301 d\u0301", "½ ² Ⅷ x", "e\u0301e\u0301 a b", "a‿b c d", "don't '' _ x", "", "?", "¿？"]
    texts = [a.format(w) for w in words for a in around] + odd
    # a text to a conversation, then all again by an assistant and as a reply
    turns = [(6 * i + k, t, role, text) for i, text in enumerate(texts) for k in (1, 2, 3, 4) for t, role in ((0, "user"), (1, "assistant"))]
    # one text to a community, so that no two differences make up for one another
    path = tables(conversations=(turns, TURNS))
    got = profile.candidate_kinds(src.messages(spark, path).withColumn("community_id", F.col("message_id"))).collect()
    sql = oracles.oracle_sql()["candidate_kinds"].replace("SELECT community_id, count(*) AS messages", "SELECT message_id, count(*) AS messages")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
        want = {r[0]: r[1:] for r in c.execute(sql).fetchall()}
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert sorted(map(tuple, queries.candidate_kinds(spark, path).collect())) == sorted(by_sql("candidate_kinds", path, "conversations"))


@pytest.mark.parametrize("dictionary, chunk, chars", [(1 << 20, 32_000, 32_000), (40, 32_000, 32_000), (0, 32_000, 32_000), (1 << 20, 20, 32_000), (300, 32_000, 9)])
def test_tfidf_of_any_dictionary_and_length_of_text(spark, tables, monkeypatch, dictionary, chunk, chars):
    monkeypatch.setattr(clusters, "DICTIONARY", dictionary)
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    monkeypatch.setattr(ngrams, "DICTIONARY_CHARS", chars)
    texts = ["the same text", "the same words, other text", "好好学习 天天向上", "", "a", "ab", "aaaaaaa", "é 👍👍👍 ñ", "zero \0 \0 byte", None, "the " * 40, "x" * 19, "x" * 20, "x" * 21, "x" * 22, "x" * 23, "abc" * 20]
    rows = [(f"m{i}", t) for i, t in enumerate(texts)] + [("m0", "again the same"), ("m3", "once more"), (None, "no name"), (None, "none of the same"), ("m9", None)]
    got = {r.message_id: r for r in clusters.tfidf_totals(spark.createDataFrame(rows, "message_id string, norm string").repartition(3)).collect()}
    grams = {}
    for k, t in rows:
        grams.setdefault(k, Counter()).update(t[i : i + n] for n in (2, 3, 4) for i in range(len(t or "") - n + 1))
    df = Counter(g for x in grams.values() for g in x)
    want = {k: [(1 + math.log(tf)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, tf in x.items()] for k, x in grams.items() if x}
    assert {k: r.terms for k, r in got.items()} == {k: len(w) for k, w in want.items()}
    for k, w in want.items():
        assert got[k].weight_sum == pytest.approx(sum(w) / math.sqrt(sum(v * v for v in w)))


def test_ngrams_start_anew_where_the_alphabet_is_full(monkeypatch):
    monkeypatch.setattr(ngrams, "ALPHABET", 12)
    monkeypatch.setattr(ngrams, "CHUNK", 8)
    monkeypatch.setattr(ngrams, "HELD", 20)
    texts = ["abcd", "efgh", "abab", "ijkl", "mnopabcd", "ab", "x", "abababababababababc", "abcdabcda", "abcdabcdabc", "abcdabcdabcd"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], ["id", "text"])
    got = Counter()
    for b in ngrams.frequencies(iter([batch, batch]), 2, 4):
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert got == Counter(g for t in texts * 2 for g in {t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)})
    got = Counter()
    for b in ngrams.pairs(iter([batch]), 2, 4):
        for i, term, n in zip(*(c.to_pylist() for c in b.columns)):
            got[i, term] += n
    want = Counter((str(i), t[j : j + n]) for i, t in enumerate(texts) for n in (2, 3, 4) for j in range(len(t) - n + 1))
    assert {k: n for k, n in got.items() if n} == want


def test_tfidf_weights_make_no_row_for_each_term_of_a_message(spark, tables):
    turns = [(c, t, "user", f"text {c} of turn {t} " * 5) for c in range(40) for t in range(3)]
    path = tables(conversations=(turns, TURNS))
    out = queries.tfidf_weights(spark, path)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert sorted((r.message_id, r.terms, r.weight_sum) for r in out.collect()) == sorted(by_sql("tfidf_weights", path, "conversations"))
