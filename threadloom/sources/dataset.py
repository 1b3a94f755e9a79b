"""A dataset as six tables: read with declared types and checks, written once and never over another."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.validation import campaign_rules, message_rules

FILES = {"messages": "messages.jsonl", "campaigns": "campaigns.json", "claims": "claims.json", "outcomes": "outcomes.csv", "annotations": "annotations.jsonl", "manifest": "manifest.json"}
_TYPES = {"messages": schema.MESSAGES, "campaigns": schema.CAMPAIGNS, "claims": schema.CLAIMS, "outcomes": schema.OUTCOMES, "annotations": schema.ANNOTATIONS, "manifest": schema.MANIFEST}


@dataclass
class Dataset:
    messages: DataFrame
    campaigns: DataFrame
    claims: DataFrame
    outcomes: DataFrame
    annotations: DataFrame
    manifest: DataFrame

    def violations(self) -> DataFrame:
        """Rows (rule, key) of every broken constraint."""
        return message_rules(self.messages).unionByName(campaign_rules(self.campaigns, self.claims, self.outcomes, self.messages))


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    reader = spark.read.schema(_TYPES[name]).option("mode", "FAILFAST")
    if FILES[name].endswith(".csv"):
        return reader.csv(f"{path}/{FILES[name]}", header=True)
    return reader.json(f"{path}/{FILES[name]}", multiLine=FILES[name].endswith(".json"))


def read_dataset(spark: SparkSession, path: str) -> Dataset:
    """The six files of a dataset (or folders of part files by these names); a value that doesn't fit its type fails the read.

    Where the manifest has checksums, content that differs from them, or a generation that isn't theirs, is a ValueError.
    """
    data = Dataset(**{name: _read(spark, path, name) for name in FILES})
    told = data.manifest.where("artifact_checksums IS NOT NULL").select("dataset_id", "generation_id", "artifact_checksums").first()
    if told is not None:
        have = checksums(data)
        if told.artifact_checksums != have:
            raise ValueError("checksum mismatch: " + ", ".join(sorted(k for k in have if told.artifact_checksums.get(k) != have[k])))
        if told.generation_id != generation_id(told.dataset_id, have):
            raise ValueError("generation identifier mismatch")
    return data


def read_strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as variants: a key that occurs twice in an object fails the read."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))


def checksums(data: Dataset) -> dict[str, str]:
    """The content's checksum of each table but the manifest, by its file's name."""
    return {FILES[n]: checksum(getattr(data, n).select(*[c.split()[0] for c in _TYPES[n].split(", ")])).first()[0] for n in FILES if n != "manifest"}


def sealed(data: Dataset) -> Dataset:
    """data with its checksums and generation in the manifest."""
    found = checksums(data)
    id_ = data.manifest.select("dataset_id").first()
    stamp = F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv])
    return replace(data, manifest=data.manifest.withColumns({"artifact_checksums": stamp, "generation_id": F.lit(generation_id(id_[0], found) if id_ else None)}))


def write_dataset(data: Dataset, path: str) -> None:
    """Writes each table as a folder by its file's name into a folder beside path, reads that back, and renames it to path at once, so that path has a
    whole dataset or none. Fails if path is there."""
    spark = data.messages.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    there, made = hadoop.Path(path), hadoop.Path(staging)
    files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(there):
        raise FileExistsError(path)
    try:
        for name in FILES:
            table, at = getattr(data, name), f"{staging}/{FILES[name]}"
            if name in ("campaigns", "claims", "manifest"):  # one array each: these few rows describe the others
                table = table.agg(F.to_json(F.collect_list(F.struct("*")), {"ignoreNullFields": "false"}).alias("value"))
                table.write.text(at)
            elif FILES[name].endswith(".csv"):
                table.write.csv(at, header=True)
            else:
                table.write.option("ignoreNullFields", "false").json(at)
        read_dataset(spark, staging)
        if files.exists(there) or not files.rename(made, there):
            raise FileExistsError(path)
    finally:
        files.delete(made, True)


def serialized(df: DataFrame) -> DataFrame:
    """Rows as JSON with keys in order, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def checksum(df: DataFrame) -> DataFrame:
    """One row: a digest of the rows' content that doesn't depend on their order; rows are digested where they are and only sums move."""
    h = F.sha2("line", 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return serialized(df).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *[part(i).cast("string") for i in range(5)]), 256).alias("checksum"))


def generation_id(dataset_id: str, checksums: dict[str, str]) -> str:
    """Identity of a dataset's content."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"artifact_checksums": checksums, "dataset_id": dataset_id}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def json_ready(df: DataFrame) -> DataFrame:
    """Numbers that JSON lacks become null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as Parquet and as JSON lines."""
    for name, df in sections.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")
        json_ready(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}.jsonl")
