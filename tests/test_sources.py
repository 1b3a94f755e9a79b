import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import dataset
from threadloom.sources.chat_export import exported_records, html_messages, import_counts, import_identities, import_messages, import_problems
from threadloom.sources.documents import read_documents
from threadloom.sources.synthetic import LEAST, allocation, generate_dataset, generate_messages

EXPORT = {"id": 1, "name": "n", "type": "t", "messages": [
    {"id": 1, "type": "service", "date_unixtime": "1700000000"}, {"id": 2, "type": "message", "date_unixtime": "1700000001", "from": "Ann", "from_id": "u1", "text": ["Hello ", {"type": "bold", "text": "world"}]},
    {"id": 3, "type": "message", "date_unixtime": "1700000002", "from": None, "from_id": "u1", "from_username": "@ann", "text": ""}, {"id": 4, "type": "message", "date": "2023-11-14T22:13:30+00:00", "from_id": "u1", "from_username": "@ann", "reply_to_message_id": 2, "text": "plain"},
    {"id": 5, "type": "message", "date_unixtime": "1700000003", "from_id": "u2", "reply_to_message_id": 9, "text": "late"}]}


def test_chat_export(spark):
    records = exported_records(spark.createDataFrame([(0, json.dumps(EXPORT))], "export int, value string"))
    m = import_messages(records, "c1", "en")
    rows = {r.text: r for r in m.collect()}
    assert set(rows) == {"Hello world", "plain", "late"} and rows["plain"].reply_to_message_id == rows["Hello world"].message_id
    assert rows["late"].reply_to_message_id is None and rows["late"].reply_to_source_key is not None
    assert import_counts(records, m).first().asDict() == {"skipped_service": 1, "skipped_textless": 1, "dropped_replies": 1}
    who = {r.display_name: r for r in import_identities(records, "c1").collect()}
    assert who["Ann"].platform_handle == "@ann" and who["Ann"].pseudonym.startswith("User ")
    assert import_messages(records, "c1", salt="s").first().user_id_hash != m.first().user_id_hash


def test_html_pages(spark):
    block = lambda i, name, joined, body, extra="": f'<div class="message default{" joined" if joined else ""}" id="message{i}"><div class="pull_right date details" title="01.07.2024 12:00:00">t</div>{extra}{f"<div class=from_name>{name}</div>" if name else ""}<div class="text">{body}</div></div>'
    reply = '<div class="reply_to details">In reply to <a href="#go_to_message1">x</a></div>'
    pages = [(0, block(1, "Ann", False, "a<br>b &amp; c") + block(2, "", True, "more", reply)), (1, block(3, "", True, "carried") + block(4, "", False, "nobody"))]
    rows = [(r.source_id, r.sender, r.text, r.reply_id, r.timestamp.hour) for r in html_messages(spark.createDataFrame(pages, "page int, html string")).orderBy("page", "pos").collect()]
    assert rows == [("1", "Ann", "a b & c", None, 10), ("2", "Ann", "more", "1", 10), ("3", "Ann", "carried", None, 10)]


def test_synthetic(spark):
    m = generate_messages(spark, 7, 120)
    assert sum(allocation(120)) == 120 and m.count() == 120 and m.select("message_id").distinct().count() == 120
    assert m.exceptAll(generate_messages(spark, 7, 120)).count() == 0 and generate_messages(spark, 8, 120).exceptAll(m).count() > 0
    assert {r.community_id for r in m.select("community_id").distinct().collect()} == {"community_a", "community_b", "community_c", "community_d"}
    try:
        allocation(LEAST - 1)
        raise AssertionError
    except ValueError:
        pass


def test_dataset_round_trip(spark, tmp_path):
    from threadloom import schema

    empty = {n: spark.createDataFrame([], getattr(schema, n.upper())) for n in ("claims", "annotations", "outcomes", "manifest")}
    m = generate_messages(spark, 1, 60).drop("campaign_id").withColumn("campaign_id", F.lit("x"))
    camps = spark.sql("SELECT 'x' AS campaign_id, 'X' AS campaign_name, timestamp'2026-01-01' AS start_time, timestamp'2027-01-01' AS end_time, 'b' AS campaign_brief")
    dataset.write_dataset(dataset.Dataset(messages=m, campaigns=camps, **empty), str(tmp_path / "d"))
    back = dataset.read_dataset(spark, str(tmp_path / "d"))
    assert back.messages.exceptAll(m.select(*back.messages.columns)).count() == 0 and back.violations().count() == 0
    assert dataset.checksum(back.messages).first()[0] == dataset.checksum(m.select(*back.messages.columns).repartition(5)).first()[0]
    assert dataset.json_ready(spark.sql("SELECT double('NaN') AS x")).first().x is None


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A title\r\n\r\nSome text that is long enough")
    (tmp_path / "b.txt").write_bytes(b"short")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe bytes that are not text at all")
    out = {r.path.rsplit("/")[-1]: (r.content, r.problem) for r in read_documents(spark, str(tmp_path)).collect()}
    assert out["a.md"] == ("# A title\n\nSome text that is long enough", None) and out["b.txt"][1] == "too_short" and out["c.txt"][1] == "not_utf8"


def test_published_datasets(spark, tmp_path):
    made = generate_dataset(spark, 3, 60)
    assert (made.claims.count(), made.outcomes.count(), made.annotations.count(), made.campaigns.count()) == (7, 12, 60, 3) and made.violations().count() == 0
    assert made.annotations.where("expected_question_status = 'answered'").count() == 12 and made.annotations.where("size(expected_behaviors) <> 1").count() == 0
    path = str(tmp_path / "d")
    dataset.write_dataset(made, path)
    assert dataset.read_dataset(spark, path).messages.count() == 60 and not [p for p in tmp_path.iterdir() if "staging" in p.name]
    with pytest.raises(FileExistsError):
        dataset.write_dataset(made, path)
    # a changed table isn't read; one that doesn't fit its manifest isn't published
    changed = dataset.Dataset(**{n: getattr(made, n) for n in dataset.FILES if n != "claims"}, claims=made.claims.limit(6))
    with pytest.raises(ValueError, match="claims.json"):
        dataset.write_dataset(changed, str(tmp_path / "e"))
    assert [p.name for p in tmp_path.iterdir()] == ["d"]


def test_rich_texts_and_problems(spark):
    messages = [{"id": 1, "type": "message", "date_unixtime": "1700000000", "from_id": "u", "text": ["a ", {"text": ["b ", {"text": "c"}, 7]}, {"type": "x"}]}, {"id": 1, "type": "message", "date": "2024-01-01T00:00:00", "text": "again"}, {"id": 3, "type": "message", "date": "never", "text": "late"}, {"type": "message", "date_unixtime": "1", "text": "x"}]
    records = exported_records(spark.createDataFrame([(0, json.dumps({"messages": messages}))], "export int, value string"))
    assert [r.text for r in records.orderBy("pos").collect()] == ["a b c", "again", "late", "x"]
    assert [(r.pos, r.problem) for r in import_problems(records).orderBy("pos").collect()] == [(0, "repeated_id"), (1, "repeated_id"), (2, "unreadable_time"), (3, "missing_id")]


def test_entities(spark):
    from threadloom.functions.text import html_to_text

    rows = ["a &amp; b", "caf&eacute; &#8364;&#x41; &lt;p&gt;", "&amp;lt; x", None, "no entities & all"]
    out = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, h string").select("i", html_to_text(F.col("h")).alias("t"))
    assert {r.i: r.t for r in out.collect()} == {0: "a & b", 1: "café €A <p>", 2: "&lt; x", 3: None, 4: "no entities & all"}
