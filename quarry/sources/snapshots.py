"""Versioned fact tables: one folder a snapshot, and a pointer that is flipped last.

Readers keep the snapshot they opened; a load that fails leaves the pointer as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/current"))

    def current(self) -> str | None:
        """Id of the newest published snapshot."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/current")))
        return names[-1].split("-", 1)[1] if names else None

    def publish(self, facts: dict[str, DataFrame]) -> str:
        """Write all tables, symbols partitioned by tier, then flip the pointer; returns the id."""
        key = uuid.uuid4().hex
        for name, df in facts.items():
            w = df.write
            if name == "symbols":
                w = w.partitionBy("tier_rank")
            elif name == "ast_nodes":
                w = w.partitionBy("kind")
            w.parquet(f"{self.folder}/{key}/{name}")
        count = len(self._fs.listStatus(self._path(f"{self.folder}/current")))
        self._fs.createNewFile(self._path(f"{self.folder}/current/{count:09d}-{key}"))
        return key

    def open(self, key: str | None = None) -> dict[str, DataFrame]:
        """Tables of a snapshot (the current one by default)."""
        key = key or self.current()
        if key is None:
            raise LookupError("no snapshot is published")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{key}"))]
        return {n: self.spark.read.parquet(f"{self.folder}/{key}/{n}") for n in names}
