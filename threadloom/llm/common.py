"""What the operators share: row identity, tables written in the shared folder, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of a row's identity: a hash of its file's path, and its place in that file.
ROW_FILE, ROW_INDEX = "__row_file", "__row_index"

#: Edges that one task joins to components.
FEW_EDGES = 200_000

#: While a table is written: shuffle files go when the step ends, and Python workers get few texts at a time, whatever their length.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's. Where none is set, as in tests, a local master may use a local folder; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


class Workspace:
    """Tables of one run of an operator in the shared folder; each write cuts the lineage there.

    A lost executor costs the tasks of the step under way, not those before it. Shuffle files of a
    finished step are released at once where the Spark version can do so.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        conf, before = self.spark.conf, {k: self.spark.conf.get(k, None) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            (df.select(*columns) if columns else df).write.mode("errorifexists").parquet(f"{self.path}/{name}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in names:
            path = hadoop.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (ROW_FILE, ROW_INDEX, doc_id, text) of docs, whatever other columns it has.

    The identity is that of the stored row, so it is the same whenever the table is read again, and
    differs between repeated rows. A frame that isn't read from Parquet is written to the shared folder first.
    """
    located = _located(docs)
    if located is None:
        located = _located(ws.write(docs, "input"))
    frame, path, index = located
    cols = [F.xxhash64(path).alias(ROW_FILE), index.alias(ROW_INDEX), frame[id_col].cast("long").alias("doc_id"), frame[text_col].cast("string").alias("text")]
    return frame.select(*cols, *(c.alias(n) for n, c in (extra or {}).items()))


def located_docs(docs: DataFrame, ws: Workspace) -> DataFrame:
    """All columns of docs, and ROW_FILE and ROW_INDEX."""
    located = _located(docs)
    if located is None:
        located = _located(ws.write(docs, "input_all"))
    frame, path, index = located
    return frame.select(*[frame[f"`{c}`"] for c in frame.columns], F.xxhash64(path).alias(ROW_FILE), index.alias(ROW_INDEX))


def _located(docs: DataFrame) -> tuple[DataFrame, Column, Column] | None:
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"]).schema  # noqa: B018
        return docs, meta["file_path"], meta["row_index"]
    except AnalysisException:
        return None


def stored(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs, or a copy in the shared folder where its rows have no place of their own yet."""
    return docs if _located(docs) else ws.write(docs, "stored")


def without_rows(docs: DataFrame, ws: Workspace, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose identity is in dropped, with the columns of docs."""
    located = located_docs(docs, ws)
    kept = located.hint("merge").join(dropped.select(ROW_FILE, ROW_INDEX).distinct(), [ROW_FILE, ROW_INDEX], "left_anti")
    return kept.drop(ROW_FILE, ROW_INDEX)


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) of one task."""
    ends = [np.zeros((2, 0), np.int64), *(np.stack([np.asarray(b.column(c)) for c in ("a", "b")]) for b in batches)]
    nodes, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (u, v, label[u], label[v]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has an edge.

    The edges are written and counted. FEW_EDGES at most (16 bytes each) are joined by one task, without a shuffle. Beyond that labels fall to the smallest among
    the neighbours, then jump to their label's label; each round is written to the shared folder, and the number of rounds grows
    with the logarithm of a path's length.
    """
    edges = ws.write(edges.select("a", "b"), f"{name}_few")
    if edges.count() <= FEW_EDGES:
        return ws.write(edges.coalesce(1).mapInArrow(_labels, "node long, component long"), f"{name}_labels")
    both = ws.write(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_edges")
    labels = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), f"{name}_0")
    k = 0
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        # what a label's own node has learnt reaches all rows that carry the label
        told = met.groupBy(F.col("old").alias("at")).agg(F.min("mid").alias("told"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = met.join(told, F.col("old") == F.col("at")).select("node", "old", F.least("mid", "told").alias("mid")).join(jump, "mid", "left")
        new = new.select("node", "old", F.least("mid", "far").alias("component"))
        k += 1
        written = ws.write(new, f"{name}_{k}")
        changed = written.where(F.col("component") < F.col("old")).limit(1).count()
        ws.drop(f"{name}_{k - 1}")
        labels = written.select("node", "component")
        if not changed:
            ws.drop(f"{name}_edges")
            return labels


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
