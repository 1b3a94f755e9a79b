"""Chat exports: JSON with messages, and pages of HTML."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Steps


def _digest(prefix: str, value: Column, length: int = 64) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, length))


def exported_records(exports: DataFrame) -> DataFrame:
    """(export, pos, id, type, sender, name, handle, at, text, reply): the messages of exports (export, value: JSON text) in their order.

    A text is a string or a list of strings and objects, whose text is again such; all are joined in order. The time is date_unixtime, else date.
    """
    spark = exports.sparkSession
    each = spark.sql("SELECT e.export, m.pos, m.value AS v FROM (SELECT export, parse_json(value) AS doc FROM {e}) e, LATERAL variant_explode(variant_get(e.doc, '$.messages')) m", e=exports)
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    rows = each.select("export", "pos", get("id").alias("id"), get("type").alias("type"), F.coalesce(get("from_id"), get("actor_id"), get("from"), F.concat(F.lit("unknown-sender:"), get("id"))).alias("sender"), get("from").alias("name"), F.coalesce(get("from_username"), get("username")).alias("handle"),
                       F.coalesce(F.timestamp_seconds(get("date_unixtime").try_cast("bigint")), F.try_to_timestamp(get("date"))).alias("at"), get("reply_to_message_id").alias("reply"), F.try_variant_get("v", "$.text", "variant").alias("t"))
    # rich texts are few and as deep as they please: only these go to Python
    rich = F.expr("schema_of_variant(t) LIKE 'ARRAY%'")
    plain = F.when(F.expr("schema_of_variant(t) = 'STRING'"), F.try_variant_get("t", "$", "string"))
    text = F.when(rich, F.arrow_udf(_flat_texts, "string")(F.when(rich, F.to_json("t")))).otherwise(F.coalesce(plain, F.lit("")))
    return rows.select("export", "pos", "id", "type", "sender", "name", "handle", "at", text.alias("text"), "reply")


def _flat_text(value: object) -> str:
    if isinstance(value, list):
        return "".join(_flat_text(x.get("text", "") if isinstance(x, dict) else x if isinstance(x, str) else "") for x in value)
    return value if isinstance(value, str) else ""


def _flat_texts(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _flat_text(json.loads(t)) for t in texts.to_pylist()], pa.string())


def import_problems(records: DataFrame) -> DataFrame:
    """(export, pos, problem): messages without an id, a time that can be read, or an id of their own."""
    own = Window.partitionBy("export", "id")
    problem = F.when(F.col("id").isNull(), "missing_id").when(F.col("at").isNull(), "unreadable_time").when(F.count(F.lit(1)).over(own) > 1, "repeated_id")
    found = records.where("type = 'message'").withColumn("problem", problem)
    return found.where("problem IS NOT NULL").select("export", "pos", "problem")


def import_messages(records: DataFrame, community_id: str, language: str = "und", salt: str | None = None) -> DataFrame:
    """Messages of exported records: service and textless ones are left out, ids are digests, and a reply counts if its parent came earlier in the export and not later in time.

    reply_to_source_key keeps the id of a parent that isn't there, so that a later import can resolve it.
    """
    kept = records.where((F.col("type") == "message") & (F.trim("text") != ""))
    key = lambda c: _digest("tg_", F.to_json(F.struct(F.lit(community_id).alias("community"), c.alias("message"))), 24)
    who = F.struct(F.lit(community_id).alias("community"), *([F.lit(salt).alias("salt")] if salt else []), F.col("sender"))
    rows = kept.select("export", "pos", "id", "reply", F.col("at").alias("timestamp"), "text", key(F.col("id")).alias("message_id"), _digest("usr_", F.to_json(who)).alias("user_id_hash"))
    parent = rows.select(F.col("export").alias("p_export"), F.col("id").alias("p_id"), F.col("pos").alias("p_pos"), F.col("timestamp").alias("p_at"), F.col("message_id").alias("p_message"))
    out = rows.join(parent, (F.col("export") == F.col("p_export")) & (F.col("reply") == F.col("p_id")) & (F.col("p_pos") < F.col("pos")) & (F.col("p_at") <= F.col("timestamp")), "left")
    return out.select("message_id", F.lit(community_id).alias("community_id"), F.lit(language).alias("language"), "user_id_hash", F.lit("user").alias("user_role"), "timestamp", "text", F.col("p_message").alias("reply_to_message_id"), F.lit(None).cast("string").alias("campaign_id"),
                      F.when(F.col("reply").isNotNull(), key(F.col("reply"))).alias("reply_to_source_key"))


def import_counts(records: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: records left out for being services or textless, and replies dropped."""
    textless = (F.col("type") == "message") & (F.trim("text") == "")
    a = records.agg(F.count_if(F.coalesce(F.col("type") != "message", F.lit(True))).alias("skipped_service"), F.count_if(textless).alias("skipped_textless"))
    return a.crossJoin(messages.agg(F.count_if(F.col("reply_to_source_key").isNotNull() & F.col("reply_to_message_id").isNull()).alias("dropped_replies")))


def import_identities(records: DataFrame, community_id: str, salt: str | None = None) -> DataFrame:
    """A row for each sender: the last name and handle given, and a pseudonym from the digest."""
    who = F.struct(F.lit(community_id).alias("community"), *([F.lit(salt).alias("salt")] if salt else []), F.col("sender"))
    name = F.when(F.trim("name") != "", F.substring(F.trim("name"), 1, 200))
    bare = F.regexp_replace(F.trim("handle"), "^@+", "")
    rows = records.where((F.col("type") == "message") & (F.trim("text") != "")).select(_digest("usr_", F.to_json(who)).alias("user_id_hash"), "export", "pos", name.alias("n"), F.when(bare != "", F.concat(F.lit("@"), F.substring(bare, 1, 64))).alias("h"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("export", "pos", c)))[c]
    out = rows.groupBy("user_id_hash").agg(last("n").alias("display_name"), last("h").alias("platform_handle"))
    return out.withColumn("pseudonym", F.concat(F.lit("User "), F.upper(F.substring("user_id_hash", 5, 4)))).withColumn("community_id", F.lit(community_id))


RECORD = "array<struct<source_id: string, sender: string, joined: boolean, local_time: string, text: string, reply_id: string>>"


@dataclass
class _Node:
    """An element: its tag, attributes and content (texts and elements)."""

    tag: str
    attrs: dict[str, str | None]
    content: list[str | _Node] = field(default_factory=list)

    def within(self, wanted: Callable[[_Node], bool]) -> Iterator[_Node]:
        """Outermost elements inside that are wanted, in order."""
        for x in self.content:
            if isinstance(x, _Node):
                if wanted(x):
                    yield x
                else:
                    yield from x.within(wanted)

    def divs(self, *classes: str) -> list[_Node]:
        """Outermost divs inside that have all these classes."""
        return list(self.within(lambda x: x.tag == "div" and {*classes} <= {*(x.attrs.get("class") or "").split()}))

    def words(self) -> str:
        """The text inside, white space collapsed; a break separates words."""
        return re.sub(r"\s+", " ", self._text()).strip()

    def _text(self) -> str:
        return "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else x._text() for x in self.content)


class _Reader(HTMLParser):
    """Reads a page into a tree. An end tag closes the nearest open element of its name; others that are open inside close with it."""

    ALONE = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.path = [_Node("", {})]
        self.feed(html)
        self.close()

    @property
    def root(self) -> _Node:
        return self.path[0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.path[-1].content.append(node)
        if tag not in self.ALONE:
            self.path.append(node)

    def handle_endtag(self, tag: str) -> None:
        names = [x.tag for x in self.path]
        if tag in names[1:]:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        self.path[-1].content.append(data)


def _record(block: _Node) -> dict:
    """What a message's block says, by the classes of its parts."""
    senders = [x.words() for x in block.divs("from_name")]
    links = [a.attrs.get("href") or "" for x in block.divs("reply_to") for a in x.within(lambda x: x.tag == "a")]
    reply = re.search(r"#go_to_message(\d+)", links[-1]) if links else None
    times = [x.attrs.get("title") for x in block.divs("date", "details")]
    return {
        "source_id": (block.attrs.get("id") or "").removeprefix("message"), "sender": next(filter(None, senders), None), "joined": "joined" in (block.attrs.get("class") or "").split(), "local_time": times[-1] if times else None,
        "text": re.sub(r"\s+", " ", " ".join(x.words() for x in block.divs("text"))).strip(), "reply_id": reply[1] if reply else None,
    }


def _page_messages(pages: pd.Series) -> pd.Series:
    return pages.map(lambda html: [_record(x) for x in _Reader(html or "").root.divs("message", "default")])


def html_messages(pages: DataFrame, zone: str = "Europe/Rome") -> DataFrame:
    """(page, pos, source_id, sender, timestamp, text, reply_id) of pages (page, html): a joined message has the sender of the last that names one, over pages too; local
    times become UTC; messages without text, sender, id or time are left out."""
    rows = pages.select("page", F.posexplode(F.pandas_udf(_page_messages, RECORD)("html")).alias("pos", "m")).select("page", "pos", "m.*")
    # only the places where a sender is named cross pages; a page's own rows are filled in beside it
    within = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last("sender", ignorenulls=True).over(within))
    tails = rows.groupBy("page").agg(F.max(F.when(F.col("sender").isNotNull(), F.struct("pos", "sender")))["sender"].alias("tail"))
    # the last sender before each page: within its range of pages, else that of the ranges before
    tails = Steps(pages.sparkSession, "pages").cut(tails.repartitionByRange("page").withColumn("range", F.spark_partition_id()))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = tails.groupBy("range").agg(F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("page"))).alias("last"))
    ranges = ranges.withColumn("earlier", F.last("last", ignorenulls=True).over(before((), "range"))).select("range", "earlier")
    heads = tails.withColumn("near", F.last("tail", ignorenulls=True).over(before(("range",), "page"))).join(ranges, "range").select("page", F.coalesce("near", "earlier").alias("carried"))
    out = rows.join(heads, "page", "left").withColumn("sender", F.coalesce("sender", F.when(F.col("joined"), F.coalesce("own", "carried"))))
    at = F.to_utc_timestamp(F.try_to_timestamp(F.substring("local_time", 1, 19), F.lit("dd.MM.yyyy HH:mm:ss")), zone)
    return out.where("text != '' AND sender IS NOT NULL AND source_id != ''").select("page", "pos", "source_id", "sender", at.alias("timestamp"), "text", "reply_id").where("timestamp IS NOT NULL")
