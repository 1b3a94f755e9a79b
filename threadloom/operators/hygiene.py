"""Repeated content, filler and posting bursts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_filler, normalize


def content_ratios(messages: DataFrame, shortest: int = 3, repeats: int = 3) -> DataFrame:
    """Per community: share of messages that repeat an earlier text, of filler, and of texts that one user posts `repeats` times or more.

    Counts are taken by (community, text, user) once; both coarser groupings are sums of these, so a hot text collapses before any shuffle.
    """
    norm = messages.select("community_id", "user_id_hash", normalize(F.col("text")).alias("norm"))
    each = norm.groupBy("community_id", "norm", "user_id_hash").agg(F.count(F.lit(1)).alias("n"))
    by_text = each.groupBy("community_id", "norm").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") >= repeats, F.col("n")).otherwise(0)).alias("repetitive"))
    total = F.sum("n")
    share = lambda x: F.coalesce(F.sum(x).cast("double") / total, F.lit(0.0))
    return by_text.groupBy("community_id").agg(
        total.alias("message_count"), share(F.col("n") - 1).alias("duplicate_ratio"), share(F.when(is_filler(F.col("norm"), shortest), F.col("n")).otherwise(0)).alias("filler_ratio"), share(F.col("repetitive")).alias("repetitive_content_ratio")
    )


def supporting_messages(messages: DataFrame, shortest: int = 3, repeats: int = 3, window_seconds: int = 60) -> DataFrame:
    """(community_id, finding, message_id): the messages that a community's rates rest on: those of one text, fillers, one user's repeats, bursts."""
    filler = messages.where(is_filler(normalize(F.col("text")), shortest)).select("community_id", "message_id")
    same = duplicate_members(messages).select("community_id", "message_id")
    again = duplicate_members(messages, ("community_id", "user_id_hash"), repeats).select("community_id", "message_id")
    quick = bursts(messages, 3, window_seconds).select("community_id", F.explode("message_ids").alias("message_id")).distinct()
    kinds = (("duplicate", same), ("filler", filler), ("repetitive", again), ("burst", quick))
    return reduce(DataFrame.unionByName, [rows.select("community_id", F.lit(k).alias("finding"), "message_id") for k, rows in kinds])


def duplicate_members(messages: DataFrame, keys: tuple[str, ...] = ("community_id",), least: int = 2) -> DataFrame:
    """Messages of each group of `least` or more with one text: the keys, group_id, message_id and group_size; a row each, however large the group."""
    norm = messages.select(*keys, "message_id", F.sha2(normalize(F.col("text")), 256).alias("group_id"))
    groups = norm.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") >= least)
    return norm.join(groups, [*keys, "group_id"])


def bursts(messages: DataFrame, minimum: int = 3, window_seconds: int = 60, keys: tuple[str, ...] = ("community_id", "user_id_hash"), time: str = "timestamp", id_: str = "message_id") -> DataFrame:
    """Maximal windows of window_seconds with `minimum` messages of one actor or more: start, end, count and the ids in order.

    A message's window reaches back from it; it is maximal unless the next message's window begins at the same place. An actor's rows are one
    partition of the window, sorted and spilled by Spark.
    """
    by = Window.partitionBy(*keys).orderBy(time, id_)
    rows = messages.select(*keys, time, id_, F.unix_micros(F.col(time).cast("timestamp")).alias("__at")).withColumn("__rn", F.row_number().over(by))
    back = Window.partitionBy(*keys).orderBy("__at").rangeBetween(-window_seconds * 1_000_000, 0)
    rows = rows.withColumn("__left", F.min("__rn").over(back))
    last_of_tie = Window.partitionBy(*keys).orderBy("__rn")
    ends = rows.withColumn("__next", F.lead("__left").over(last_of_tie)).where((F.col("__next").isNull() | (F.col("__next") != F.col("__left"))) & (F.col("__rn") - F.col("__left") + 1 >= minimum))
    # a row for each place of a window, so that they meet the messages by equal keys, whatever an actor's number of messages
    spans = ends.select(*keys, "__left", F.col("__rn").alias("__right"), F.explode(F.sequence(F.col("__left"), F.col("__rn"))).alias("__rn"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "__rn")]
    joined = spans.alias("s").join(rows.alias("r"), same)
    grouped = joined.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.__left").alias("__left"), F.col("s.__right").alias("__right"))
    found = grouped.agg(F.min(f"r.{time}").alias("start_time"), F.max(f"r.{time}").alias("end_time"), F.count(F.lit(1)).alias("message_count"), F.array_sort(F.collect_list(F.struct("r.__rn", f"r.{id_}"))).alias("m"))
    return found.select(*keys, "start_time", "end_time", "message_count", F.transform("m", lambda x: x[id_]).alias("message_ids"))
