"""Artifacts: Parquet tables per stage, and a manifest that tells what they were made from.

A stage's table counts as current only if its manifest names the same inputs: config,
nodes and content digests.  Digests are sums of row hashes, so they do not depend on the
order or partitioning of rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .config import Workspace

VERSION = 1
METHOD = "mirrored-shift-score-1"
STAGES = ("01_surface", "02_shift", "03_validation", "04_selection")
#: Names of older tables and their present ones.
RENAMED = {"count": "n_obs", "hits": "n_hit", "probability": "p", "deviation": "shift"}


def content_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset, by one aggregate."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(row).alias("s"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)], F.lit(1))).alias("x")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{r.n}|{r.s}|{r.x}".encode()).hexdigest()


def history_id(panel: DataFrame) -> str:
    """Names a market history by its prices and times alone, so studies with other auxiliary columns share it."""
    return content_digest(panel.select("ts", "open", "high", "low", "close", "volume"))


def config_digest(workspace: Workspace) -> str:
    plain = {"config": asdict(workspace.config), "nodes": sorted((asdict(n) for n in workspace.nodes()), key=lambda n: n["id"]), "version": VERSION, "method": METHOD}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


class Files:
    """Small files and folders below one root of any file system that Hadoop knows (file, hdfs, s3a, ...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def names(self, folder: str) -> list[str]:
        path, files = self._path(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []

    def remove(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def read(self, name: str) -> str | None:
        path, files = self._path(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes under another name and then moves: readers see the old text or the new one."""
        path, files = self._path(name)
        other, _ = self._path(f"{name}.{uuid.uuid4().hex}")
        stream = files.create(other, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        files.delete(path, False)
        if not files.rename(other, path):
            raise OSError(f"{name} could not be written")


class Store:
    """Tables and manifests below one folder, local or remote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")
        self.files = Files(spark, self.root)

    def path(self, stage: str, name: str) -> str:
        return f"{self.root}/{stage}/{name}.parquet"

    def write(self, stage: str, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(stage, name))
        return self.read(stage, name)

    def add(self, stage: str, name: str, df: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
        """Writes into a table that is laid out by ``partition_by``: the parts that ``df`` has are replaced, all others stay."""
        schema = StructType(sorted(df.schema.fields, key=lambda f: f.name in partition_by))  # as it is read: partition columns last
        kept = self._schema(stage, name)
        if kept is not None and sorted((f.name, f.dataType.simpleString()) for f in kept) != sorted((f.name, f.dataType.simpleString()) for f in schema):
            raise ValueError(f"{stage}/{name} has other columns")
        if kept is None:
            self.files.write(f"{stage}/{name}.schema.json", schema.json())
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(self.path(stage, name))
        return self.read(stage, name)

    def remove_part(self, stage: str, name: str, column: str, value: str) -> None:
        """Removes one part of a table that is laid out by one column."""
        names = self.files.names(f"{stage}/{name}.parquet")
        self.files.remove(f"{stage}/{name}.parquet/{column}={value}") if f"{column}={value}" in names else None

    def _schema(self, stage: str, name: str) -> StructType | None:
        text = self.files.read(f"{stage}/{name}.schema.json")
        return None if text is None else StructType.fromJson(json.loads(text))

    def read(self, stage: str, name: str) -> DataFrame:
        schema = self._schema(stage, name)  # partition columns keep their types
        df = (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(self.path(stage, name))
        return df.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in df.columns and b not in df.columns})

    def kept_names(self, stage: str, prefix: str = "history-") -> list[str]:
        """What follows ``prefix`` in the names of a stage's tables."""
        return [n.removeprefix(prefix).removesuffix(".parquet") for n in self.files.names(stage) if n.startswith(prefix) and n.endswith(".parquet")]

    def has(self, stage: str, name: str) -> bool:
        return self.files.exists(f"{stage}/{name}.parquet")

    def manifest(self, stage: str) -> dict:
        """The stage's manifest; a missing or broken one is empty."""
        try:
            out = json.loads(self.files.read(f"{stage}/manifest.json") or "")
        except ValueError:
            return {}
        return out if isinstance(out, dict) else {}

    def write_manifest(self, stage: str, inputs: dict, **more: dict) -> None:
        self.files.write(f"{stage}/manifest.json", json.dumps({"version": VERSION, "method": METHOD, "inputs": inputs, **more}, indent=2))

    def is_current(self, stage: str, inputs: dict) -> bool:
        m = self.manifest(stage)
        return m.get("version") == VERSION and m.get("method") == METHOD and m.get("inputs") == inputs

    def drop_stale(self, stage: str, keep: set[str]) -> list[str]:
        """Removes tables of a stage that are not in ``keep``; returns their names."""
        gone = [n.removesuffix(".parquet") for n in self.files.names(stage) if n.endswith(".parquet") and n.removesuffix(".parquet") not in keep]
        for name in gone:
            self.files.remove(f"{stage}/{name}.parquet")
        return gone

    def snapshot(self, rows: DataFrame) -> str:
        """Keeps a source table under a name that its content gives; the same content is kept once.  Returns the path."""
        name = f"snapshots/{content_digest(rows)}.parquet"
        if not self.files.exists(f"{name}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return f"{self.root}/{name}"
