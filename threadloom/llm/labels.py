"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses at most, and parts by which rows are held out.
SAMPLE_ROWS, PARTS = 20_000, 5


def part(id_: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(id_.cast("string"), "UTF-8")) % PARTS, F.lit(0)).cast("int")


def held_out(id_: Column) -> Column:
    """Rows whose crc32(id as text) mod 5 is 0 (null ids too) are never learnt from."""
    return part(id_) == 0


def sample(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, text, label, part) to learn from: sample_rows labelled ids at most, those of the least hash.

    An id with several labels counts as 1 if half of them are; null ids and labels are left out. The chosen ids are bounded by
    sample_rows, and so is what is broadcast.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    ids = ids.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids), "doc_id").withColumn("part", part(F.col("doc_id")))
