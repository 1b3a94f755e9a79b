"""Quality of rankings against what should have been found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per query of gold or ranked: hit, precision and recall at 1, 3 and 5, precision at the number of targets, reciprocal rank and nDCG at 5; all null without targets.

    gold has query_id and target; ranked has query_id, target and rank, of which a repeated target counts at its first place.
    """
    first = ranked.groupBy("query_id", "target").agg(F.min("rank").alias("r0"))
    place = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r0", "target")))
    want = gold.select("query_id", "target").distinct()
    n = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = want.join(place, ["query_id", "target"]).join(n, "query_id")
    found = lambda k: F.count_if(F.col("rank") <= k)
    per = hits.groupBy("query_id").agg(
        *[found(k).alias(f"h{k}") for k in (1, 3, 5)], F.count_if(F.col("rank") <= F.col("n")).alias("hr"), F.min(F.when(F.col("rank") <= 5, F.col("rank"))).alias("best"),
        F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    every = ranked.select("query_id").union(gold.select("query_id")).distinct().join(n, "query_id", "left").join(per, "query_id", "left").fillna(0, ["h1", "h3", "h5", "hr"]).fillna(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    some = F.col("n").isNotNull()
    at = lambda k: [F.when(some, (F.col(f"h{k}") > 0).cast("int")).alias(f"hit_at_{k}"), F.when(some, F.col(f"h{k}") / F.lit(k)).alias(f"precision_at_{k}"), (F.col(f"h{k}") / F.col("n")).alias(f"recall_at_{k}")]
    return every.select("query_id", *at(1), *at(3), *at(5), (F.col("hr") / F.col("n")).alias("r_precision"), F.when(some, F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr_at_5"), F.when(some, F.col("dcg") / ideal).alias("ndcg_at_5"))


def containing(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, target): texts (target, body) that hold the whole text of an item (query_id, text).

    A text that holds an item has all its inner words as words of its own, so item and text meet by the item's longest inner word. Items
    of fewer than three words meet every text.
    """
    words = F.split("text", r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = items.select("query_id", "text", F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))).alias("k"))
    long = keyed.where("k IS NOT NULL").select("query_id", "text", F.col("k.w").alias("word"))
    each = texts.select("target", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("word")).join(long.select("word").distinct(), "word", "left_semi")
    met = each.join(long, "word").select("target", "query_id", "text").join(texts, "target").where(F.col("body").contains(F.col("text"))).select("query_id", "target")
    short = texts.join(keyed.where("k IS NULL AND text IS NOT NULL"), F.col("body").contains(F.col("text"))).select("query_id", "target")
    return met.unionByName(short)


def macro(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means of all metrics, over all queries or by a column; queries without targets don't count."""
    cols = [c for c, t in metrics.dtypes if t in ("double", "int", "bigint") and c not in ("query_id", by)]
    return metrics.groupBy(*([by] if by else [])).agg(*[F.avg(c).alias(c) for c in cols])


def nearest_rank(values: str | Column, share: float) -> Column:
    """The value at place ceil(n * share) of the values in order."""
    name = values if isinstance(values, str) else None
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {name})")
