"""Shared plumbing: scratch space every executor can see, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of the corpus contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the benchmark contract: runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

FRUGAL = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}

#: Texts are handed to the vectorised kernels in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``.

    The session's own setting is used where it exists.  Only a local session without one gets a
    temporary folder, removed at exit; a cluster session without one is an error, since executors
    could not see each other's files.  On a mounted file system the folder goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, own, True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, "/" + path[5:].lstrip("/"), True)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executors.

    The shuffles that made the table go as soon as it is written; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with frugal(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """For the jobs started inside: Arrow batches of a bounded size, shuffles dropped when a job ends."""
    held = {key: spark.conf.get(key, None) for key in FRUGAL}
    for key, value in FRUGAL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches cut so that no slice holds much more than SLICE_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)

    return df.mapInArrow(trimmed(run), schema)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which an idle worker gives its free memory back to the machine."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Return what the allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch, each about ``limit`` bytes; a longer single row stays whole."""
    if batch.num_rows == 0:
        return
    size = max(1, batch.nbytes)
    step = max(1, int(batch.num_rows * limit / size))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def run_location(spark: SparkSession, uri: str, make: bool = True) -> str:
    """Create the folder through Hadoop's file system, so that any shared store works."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def shared_fs(uri: str):
    """pyarrow file system and path of a URI, for Python workers that write their own formats."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
