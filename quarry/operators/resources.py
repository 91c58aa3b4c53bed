"""Declared resources and module listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def read(files: DataFrame, declared: DataFrame) -> DataFrame:
    """uri, mime, text of files (path, text) that are declared (path) and stay below the root."""
    asked = declared.select("path").distinct().where(T.safe_path(F.col("path")))
    return files.join(asked, "path", "left_semi").select(F.concat(F.lit("repo:"), F.col("path")).alias("uri"), T.mime(F.col("path")).alias("mime"), "text")


def module_path(texts: DataFrame) -> DataFrame:
    """path and module of ``go.mod`` texts (path, text); without a module line there is no row."""
    found = texts.withColumn("module", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1))
    return found.where("module <> ''").select("path", "module")


def module_list(packages: DataFrame, cap: int = T.LIST_CAP) -> DataFrame:
    """One row: the modules of the packages as JSON lines, clipped."""
    rows = packages.where("module_path is not null").groupBy("module_path").agg(F.max("module_main").alias("main"), F.min("module_indirect").alias("indirect"))
    lines = rows.select(F.to_json(F.struct(F.col("module_path").alias("Path"), F.col("main").alias("Main"), F.col("indirect").alias("Indirect"))).alias("j"))
    return lines.agg(T.clip(F.array_join(F.sort_array(F.collect_list("j")), "\n"), cap).alias("text"))


def documentation(docs: DataFrame, path: str, cap: int = T.DOC_CAP) -> DataFrame:
    """path and the clipped text of a documentation page."""
    return docs.where(F.col("path") == path).select("path", T.clip(F.col("text"), cap).alias("text"))
