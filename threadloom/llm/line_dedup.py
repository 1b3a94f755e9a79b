"""Repeated passages of three lines: windows are hashed, those that repeat are found over all documents, later ones go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, text_rows

#: Stands for a null id, before all others.
_FIRST = -(1 << 63)


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: identity, doc_id, n_lines, removed (positions of lines), kept_text.

    Lines are what newlines separate; a window is `window` consecutive lines of one text. Every line goes that is
    covered by a window whose lines also start earlier (smaller doc_id, or an earlier line of the same text; a
    null id comes first, and of repeated ids the row stored first). Windows are judged on the input. Texts of fewer lines
    have no window and stay whole. A null text has no lines and an empty kept_text; an empty text has one line.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    texts = text_rows(docs, ws, id_col, text_col).withColumn("lines", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)))
    long = texts.where(F.size("lines") >= window).select(
        F.coalesce("doc_id", F.lit(_FIRST)).alias("rank"), ROW_FILE, ROW_INDEX,
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("g"),
    )
    of = lambda name, i: F.xxhash64(*[F.element_at(name, i + k) for k in range(1, window + 1)])
    each = F.transform(F.sequence(F.lit(0), F.size("h") - window), lambda i: F.struct(i.alias("line"), of("h", i).alias("h"), of("g", i).alias("g")))
    windows = ws.write(long.select("rank", ROW_FILE, ROW_INDEX, F.explode(each).alias("w")).select("rank", ROW_FILE, ROW_INDEX, "w.*"), "windows")

    place = F.struct("rank", ROW_FILE, ROW_INDEX, "line")
    firsts = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.hint("merge").join(firsts, ["h", "g"]).where(place > F.col("first"))
    covered = later.groupBy(ROW_FILE, ROW_INDEX).agg(F.collect_set("line").alias("starts"))
    covered = covered.withColumn("removed", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))))
    covered = ws.write(covered, "covered", [ROW_FILE, ROW_INDEX, "removed"])

    # the same join at every size: what is covered grows with the texts
    out = texts.hint("merge").join(covered, [ROW_FILE, ROW_INDEX], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n"))
    return out.select(ROW_FILE, ROW_INDEX, "doc_id", F.size("lines").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept_text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH t AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS line, lines FROM t WHERE len(lines) >= 3),
k AS (SELECT doc_id, line, lines[line + 1:line + 3] AS win FROM w),
later AS (SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS rn FROM k) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, line + o AS line FROM later, (SELECT unnest([0, 1, 2]) AS o)),
each AS (SELECT doc_id, unnest(lines) AS s, unnest(range(0, len(lines))) AS line FROM t),
kept AS (SELECT e.doc_id, string_agg(e.s, chr(10) ORDER BY e.line) AS s FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.line = g.line GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(t.lines)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
