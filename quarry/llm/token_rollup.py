"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

``counted`` counts the tokens of whole texts with a tokenizer file; the version is that file's name and
checksum, so another file is another version.

A store is a folder with one data folder a batch, each with two Parquet tables:

 - ledger: signed rows (doc_id, source, lang, version, docs, tokens), partitioned by a hash of doc_id;
   their sum is what is known of each document;
 - rollup: the same added up by (source, lang, version); its sum is the totals.

``commit`` turns a batch of changes into signed rows: an insert adds; a delete subtracts what the
ledger holds of the document; a revision subtracts that and adds the new count.  Only the ledger
partitions of documents that are taken back are read.  The data folder has a name of its own; a mark
that is created exclusively then names it, and a batch whose mark exists is not applied again.  What
stopped half-way, or lost a race for the mark, has no mark and doesn't count.  All sums are of whole
numbers, so order and repetition don't matter.

``compact`` writes the state and the totals of all batches as one data folder and then a list of the
batches that it stands for; marks stay, so those batches are not applied again.

Deletes and revisions regard the state before their batch; inserts of the same batch stay.  Defined
cases: a null or empty text has 0 tokens, one of any length is counted whole; null source, lang or
version are values of their own; null counts are 0; a delete or revision of an unknown document
subtracts nothing; a document named twice in a batch is subtracted once and each of its new counts is
added, equal rows too; null doc_ids can be inserted but not taken back; an empty batch is marked and
changes nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_files

KEYS = ("source", "lang", "version")
LEDGER = "doc_id bigint, source string, lang string, version string, docs bigint, tokens bigint, part int"
ROLLUP = "source string, lang string, version string, docs bigint, tokens bigint"
PARTS = 64

_counters: dict[str, Callable[[pa.Array], np.ndarray]] = {}


def version_of(path: str) -> str:
    """Name and checksum of a tokenizer file."""
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{zlib.crc32(f.read()):08x}"


def counter(path: str, pattern: str | None = None) -> Callable[[pa.Array], np.ndarray]:
    """Numbers of tokens of a string column: a file of the tokenizers library (.json), or ranks of tiktoken with their pattern."""
    if path not in _counters:
        if path.endswith(".json"):
            _counters[path] = lambda column: token_files.encoder(path).encode(column)[1]
        else:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _counters[path] = lambda column: np.array([len(coder.encode_ordinary(t)) if t else 0 for t in column.to_pylist()], np.int64)
    return _counters[path]


def counted(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, source, lang, version, n_tokens of each row of ``docs``, and the SHA-256 of its text."""
    version = version_of(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def count(batch):
        n = counter(path, pattern)(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "digest")), pa.array(n, pa.int64())], ["doc_id", "source", "lang", "digest", "n_tokens"])

    found = common.map_arrow(rows, count, "doc_id bigint, source string, lang string, digest binary, n_tokens bigint")
    return found.select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens", "digest")


def _part():
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("data", "commits", "compacted"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _names(self, part: str) -> list[str]:
        """Files of a folder that have a content, in order."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{part}")) if s.getLen())

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{path}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, path: str, content: str) -> bool:
        """Create a small file; False if it is there."""
        try:
            stream = self._fs.create(self._path(f"{self.folder}/{path}"), False)
        except Exception:
            if self._fs.exists(self._path(f"{self.folder}/{path}")):
                return False
            raise
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    def committed(self) -> list[str]:
        """Names of the batches that count, in order of their names."""
        return self._names("commits")

    def _folders(self) -> list[str]:
        """Data folders that count: the last compaction's and those of batches after it."""
        last = self._names("compacted")[-1:]
        base = json.loads(self._read(f"compacted/{last[0]}")) if last else {"folder": None, "batches": []}
        covered = set(base["batches"])
        return [base["folder"]] * bool(last) + [self._read(f"commits/{b}") for b in self.committed() if b not in covered]

    def _log(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/data/{name}/{part}" for name in self._folders()]
        logs = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = self.spark.createDataFrame([], schema)
        for log in logs:
            out = out.unionByName(log)
        return out

    def state(self, parts: list[int] | None = None) -> DataFrame:
        """What the ledger holds of each document, of some partitions or all."""
        rows = self._log("ledger", LEDGER)
        rows = rows if parts is None else rows.where(F.col("part").isin(parts))
        sums = rows.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of what is left."""
        sums = self._log("rollup", ROLLUP).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def _write(self, name: str, signed: DataFrame) -> None:
        """Ledger and rollup of signed rows, as the data folder ``name``."""
        at = f"{self.folder}/data/{name}"
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64("doc_id", *KEYS, "tokens"), F.lit(max(1, tasks // PARTS)))
        with common.frugal(self.spark):
            signed.withColumn("part", _part()).repartition(tasks, "part", spread).write.partitionBy("part").parquet(f"{at}/ledger")
            rows = self.spark.read.schema(LEDGER).parquet(f"{at}/ledger")
            rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{at}/rollup")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, version, n_tokens) once; False if the batch was there."""
        if batch in self.committed():
            return False
        changes = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), *KEYS, F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("tokens"))
        signed = changes.where("op in ('insert', 'revise')").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        if self.committed():
            gone = changes.where("op in ('delete', 'revise') and doc_id is not null").select("doc_id").distinct()
            parts = [r.part for r in gone.select(_part().alias("part")).distinct().collect()]  # at most PARTS rows
            taken = self.state(parts).join(gone, "doc_id", "left_semi").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
            signed = signed.unionByName(taken)
        name = f"{batch}-{uuid.uuid4().hex}"
        self._write(name, signed)
        return self._claim(f"commits/{batch}", name)

    def compact(self) -> None:
        """One data folder in place of those of all batches so far, which are then deleted."""
        batches, old = self.committed(), self._folders()
        if len(old) < 2:
            return
        name = f"compacted-{uuid.uuid4().hex}"
        self._write(name, self.state())
        number = int((self._names("compacted") or ["0"])[-1]) + 1
        if self._claim(f"compacted/{number:08d}", json.dumps({"folder": name, "batches": batches})):
            for folder in old:
                self._fs.delete(self._path(f"{self.folder}/data/{folder}"), True)
