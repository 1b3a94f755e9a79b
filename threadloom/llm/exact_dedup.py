"""Exact duplicates by stateful streaming: a keyed state without expiry, on disk, and a check of full bytes on hits."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, lower_ascii, stored, text_rows, without_rows

#: Files of digests that a micro-batch takes at most; each has what one task wrote.
FILES_PER_TRIGGER = 1000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_state(arrivals: DataFrame, ws: Workspace, files_per_trigger: int | None = None) -> DataFrame:
    """(digest, n, keeper) after all arrivals have streamed through the state.

    arrivals is a table of the workspace. The state holds for each digest the count, and the identifier and
    locator of the row that stays; it is kept in RocksDB, is never expired and is checkpointed in the shared folder,
    so a restart goes on where a lost executor stopped. Each micro-batch leaves the changed entries as a table.
    """
    spark = ws.spark
    source = spark.readStream.schema(arrivals.schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    keyed = source.parquet(f"{ws.path}/arrivals").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", ROW_FILE, ROW_INDEX)).alias("keeper"))

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{ws.path}/state/{batch_id}")

    with _state_on_disk(spark):
        query = keyed.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{ws.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = "digest string, n long, keeper struct<doc_id: long, __row_file: long, __row_index: long>, batch int"
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{ws.path}/state")
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "n", "keeper")).alias("s"))
    return last.select("digest", "s.n", "s.keeper")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, files_per_trigger: int | None = FILES_PER_TRIGGER) -> DataFrame:
    """One row for each row of docs: its identity, doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; a null counts as empty. Of equal texts the row with
    the largest doc_id stays (a null id is the smallest; of repeated ids the row that is stored last), so exactly one
    row of a group has kept. Members of a group by digest are compared in full: where texts with one digest differ,
    they are grouped anew by their text. Rows stream in micro-batches of files_per_trigger files at most. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact_dedup")
    digest = digest or (lambda text: F.sha2(text, 256))
    texts = text_rows(docs, ws, id_col, text_col).withColumn("norm", lower_ascii(F.coalesce("text", F.lit("")))).drop("text")
    texts = texts.withColumn("digest", digest(F.col("norm")))
    arrivals = ws.write(texts.drop("norm"), "arrivals")
    state = ws.write(stream_state(arrivals, ws, files_per_trigger), "entries")

    hits = state.where("n > 1").select(F.col("digest").alias("hit"))
    members = ws.write(texts.hint("merge").join(hits, F.col("digest") == F.col("hit"), "left_semi"), "members")
    exact = members.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", ROW_FILE, ROW_INDEX)).alias("keeper"))
    apart = exact.groupBy("digest").count().where("count > 1").select("digest")
    apart = ws.write(apart, "apart")

    alike = arrivals.hint("merge").join(state, "digest").join(apart, "digest", "left_anti")
    differ = members.join(apart, "digest", "left_semi").join(exact, ["digest", "norm"]).drop("norm")
    out = alike.unionByName(differ)
    same = (F.col(ROW_FILE) == F.col(f"keeper.{ROW_FILE}")) & (F.col(ROW_INDEX) == F.col(f"keeper.{ROW_INDEX}"))
    return out.select(ROW_FILE, ROW_INDEX, "doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts; all columns as they are."""
    ws = Workspace(docs.sparkSession, "exact_drop")
    docs = stored(docs, ws)
    found = exact_duplicates(docs, id_col, text_col)
    return without_rows(docs, ws, found.where(~F.col("kept")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
