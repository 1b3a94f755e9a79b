"""Files of a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest characters of a document.
LEAST = 20


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, problem) of Markdown and text files: newlines made one kind, ends trimmed; a problem where too little is left or the bytes are not UTF-8."""
    raw = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(md|txt)$"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    flat = F.trim(F.regexp_replace(text, "\r\n?", "\n"))
    problem = F.when(text.isNull(), "not_utf8").when(F.char_length(flat) < LEAST, "too_short")
    return raw.select("path", flat.alias("content"), problem.alias("problem"))
