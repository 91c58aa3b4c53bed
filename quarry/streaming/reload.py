"""From file-change events to reloads.

A reload is due once no relevant event has come for the debounce time after the last one: one row a
closed session.  In a stream the state is one open session a key; there is one key (the tree), but
events are first narrowed to relevant ones.  A reload that fails leaves the old snapshot in place.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEBOUNCE = "300 milliseconds"
#: Folders whose contents are not watched (hidden ones aren't, either); the marker of an
#: editor's temporary copies; the module files.
EDITOR_MARK, MODULE_FILES = "___jb_", ("go.mod", "go.sum")
SKIPPED = ("vendor", "node_modules", "testdata", ".git")


def watched(path: Column) -> Column:
    """Whether no folder on the way is skipped or hidden."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.isin(*SKIPPED) | (f.startswith(".") & ~f.isin(".", "..") & (f != "")))


def relevant(path: Column, op: Column) -> Column:
    """Changes that matter: not of attributes alone; module files; Go files that aren't hidden or an editor's copy."""
    name = F.substring_index(path, "/", -1)
    source = name.endswith(".go") & ~name.startswith(".") & ~name.contains(EDITOR_MARK)
    return (op != "chmod") & (name.isin(*MODULE_FILES) | source)


def folders(paths: DataFrame) -> DataFrame:
    """folder: every folder on the way to a path (path) that is to be watched, the root as ``.``.

    Of a tree's paths these are the folders to register at the start; of created paths, those to add.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = paths.select(F.explode(up).alias("folder")).distinct().select(F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("folder"))
    return rows.where(watched(F.concat("folder", F.lit("/x"))))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (from the folder), modified, length of every file below a folder; contents are not read."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(base.removeprefix('file://')) + 2})")
    return files.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length")


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """fs_events (ts, path, op) that lead from one listing of a tree to another: create, write, remove."""
    old, new = before.toDF("path", "was", "size"), after.toDF("path", "modified", "length")
    both = old.join(new, "path", "full")
    op = F.when(F.col("was").isNull(), "create").when(F.col("modified").isNull(), "remove").when((F.col("was") != F.col("modified")) | (F.col("size") != F.col("length")), "write")
    return both.select(F.coalesce("modified", F.current_timestamp()).alias("ts"), "path", op.alias("op")).where("op is not null")


def follow(spark: SparkSession, folder: str, sink: str, pause: float, rounds: int | None = None) -> None:
    """Poll a tree and append its changes to the Parquet folder ``sink``, which ``reload_stream`` may read.

    New folders are seen with their files, as a listing covers the whole tree.
    """
    from ..plans.storage import keep

    known = keep(listing(spark, folder), "listing")
    while rounds is None or rounds > 0:
        time.sleep(pause)
        now = keep(listing(spark, folder), "listing")
        changes = tree_changes(known, now)
        if not changes.isEmpty():
            changes.coalesce(1).write.mode("append").parquet(sink)
        known, rounds = now, None if rounds is None else rounds - 1


def sessions(events: DataFrame, debounce: str = DEBOUNCE) -> DataFrame:
    """started, due, n_events of each reload.  An event exactly the debounce time after another joins it."""
    kept = events.where(relevant(F.col("path"), F.col("op")) & watched(F.col("path")))
    tree = F.substring("path", 1, 0)  # one tree, one key: sessions in a stream need a key
    grouped = kept.groupBy(tree, F.session_window("ts", debounce).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select(F.col("w.start").alias("started"), F.col("w.end").alias("due"), "n_events")


def reload_stream(events: DataFrame, on_reload: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = DEBOUNCE, late: str = "10 seconds") -> StreamingQuery:
    """Start the stream: ``on_reload(rows, batch)`` for each batch of closed sessions (append mode)."""
    rows = sessions(events.withWatermark("ts", late), debounce)

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            on_reload(batch, number)

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle).start()


def republish(load: Callable[[], dict[str, DataFrame]], publish: Callable[[dict[str, DataFrame]], str]) -> Callable[[DataFrame, int], None]:
    """Handler for ``reload_stream``: load the facts anew and publish them; if that fails the old ones stay.

    Sessions of one batch are one reload.
    """

    def handle(rows: DataFrame, number: int) -> None:
        try:
            logging.getLogger(__name__).info("reload %d: snapshot %s", number, publish(load()))
        except Exception:
            logging.getLogger(__name__).exception("reload %d failed; the old snapshot stays", number)

    return handle
