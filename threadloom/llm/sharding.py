"""Shards by extendible hashing: a directory over prefixes of hash bits, in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_FILE, ROW_INDEX, Workspace, located_docs, stored, text_rows, union_all

#: Bits of one key, and bits by which a pass over the rows refines the directory.
KEY_BITS, STEP_BITS = 60, 12


def _prefix(key: Column, bits: Column | int) -> Column:
    """The first bits of a 60-bit key; all of a shorter directory's paths come from the same bits."""
    return F.shiftright(key, KEY_BITS - bits) if isinstance(bits, int) else F.call_function("shiftright", key, (F.lit(KEY_BITS) - bits).cast("int"))


def directory(rows: DataFrame, limit: int, ws: Workspace) -> list[tuple[int, DataFrame]]:
    """For each pass (bits, table): fine prefixes of so many bits with the depth of the bucket that holds them.

    rows has key, key2 and n_bytes. Each pass sums bytes by prefix, for rows of buckets that are still too large only.
    A bucket splits on the next bit while it exceeds limit, unless it has one row. After 60 bits of the id's
    hash (rows of one id) the bits of the row's own identity follow.
    """
    passes, open_rows, done = [], rows, 0
    while done < 2 * KEY_BITS:
        base, key = (0, "key") if done < KEY_BITS else (KEY_BITS, "key2")
        lo, hi = done - base, done - base + STEP_BITS
        first = ["key"] if base else []
        sums = open_rows.groupBy(*first, _prefix(F.col(key), hi).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"))
        sums = ws.write(sums, f"sums_{done}")
        levels = sums.select("*", F.explode(F.sequence(F.lit(lo if done == 0 else lo + 1), F.lit(hi))).alias("bits"))
        at = F.call_function("shiftright", F.col("fine"), (F.lit(hi) - F.col("bits")).cast("int"))
        levels = levels.withColumn("prefix", at)
        total = levels.groupBy(*first, "bits", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
        fits = total.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        leaf = levels.select(*first, "fine", "bits", "prefix").join(fits, [*first, "bits", "prefix"]).groupBy(*first, "fine").agg(F.min(F.struct("bits", "prefix", "shard_bytes", "shard_docs")).alias("leaf"))
        found = ws.write(leaf.select(*first, "fine", (F.col("leaf.bits") + base).alias("depth"), "leaf.prefix", "leaf.shard_bytes", "leaf.shard_docs"), f"directory_{done}")
        passes.append((done + STEP_BITS, found))
        left = sums.join(found, [*first, "fine"], "left_anti").select(*first, "fine")
        done += STEP_BITS
        if not left.limit(1).count():
            break
        open_rows = open_rows.withColumn("fine", _prefix(F.col(key), hi)).join(left, [*first, "fine"], "left_semi").drop("fine")
    return passes


def shard_documents(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: identity, doc_id, n_bytes, shard, depth, shard_bytes, shard_docs.

    shard is the path of bits from the directory's root ('' for a single shard). Every shard holds limit_bytes of UTF-8 at
    most, unless it is one document that is larger. A null text has 0 bytes; null ids share a key and are split by
    row. Which of several rows with one id goes where depends on where they are stored. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    hashed = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    own = F.shiftrightunsigned(F.xxhash64(ROW_FILE, ROW_INDEX), 64 - KEY_BITS)
    rows = text_rows(docs, ws, id_col, text_col).select(ROW_FILE, ROW_INDEX, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hashed.alias("key"), own.alias("key2"))
    rows = ws.write(rows, "rows")
    out, left = [], rows
    passes = directory(rows, limit_bytes, ws)
    for k, (bits, found) in enumerate(passes):
        second = bits > KEY_BITS
        hi = bits - KEY_BITS * second
        fine = _prefix(F.col("key2" if second else "key"), hi)
        on = ["key", "fine"] if second else ["fine"]
        keyed = left.withColumn("fine", fine)
        out.append(keyed.join(found, on))
        if k + 1 < len(passes):
            left = keyed.join(found, on, "left_anti").drop("fine")
    got = union_all([x.select(ROW_FILE, ROW_INDEX, "doc_id", "n_bytes", "key", "depth", "prefix", "shard_bytes", "shard_docs") for x in out])
    path = lambda value, n: F.when(n == 0, "").otherwise(F.lpad(F.bin(value), n, "0"))
    deep = F.concat(path(F.col("key"), F.lit(KEY_BITS)), path(F.col("prefix"), F.col("depth") - KEY_BITS))
    shard = F.when(F.col("depth") <= KEY_BITS, path(F.col("prefix"), F.col("depth"))).otherwise(deep)
    return got.select(ROW_FILE, ROW_INDEX, "doc_id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs with a folder for each shard, and returns what shard_documents() found."""
    ws = Workspace(docs.sparkSession, "shards")
    docs = stored(docs, ws)
    found = ws.write(shard_documents(docs, limit_bytes, id_col, text_col), "found")
    placed = located_docs(docs, ws).join(found.select(ROW_FILE, ROW_INDEX, F.concat(F.lit("b"), "shard").alias("__shard")), [ROW_FILE, ROW_INDEX]).drop(ROW_FILE, ROW_INDEX)
    placed.repartition("__shard").write.partitionBy("__shard").mode("errorifexists").parquet(path)
    return found


SHARD_BYTES = 1 << 20


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs")


OP2_SQL = f"""
WITH r AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM documents),
l AS (SELECT doc_id, n_bytes, b AS depth, key >> (60 - b) AS prefix FROM r, (SELECT unnest(range(0, 41)) AS b)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM l GROUP BY ALL),
f AS (SELECT l.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS rn FROM l JOIN s USING (depth, prefix) WHERE shard_bytes <= {SHARD_BYTES} OR shard_docs = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, depth::BIGINT AS depth, shard_bytes, shard_docs
FROM f WHERE rn = 1
"""
