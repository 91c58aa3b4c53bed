"""Citations: ``path:line`` in vendored texts, resolved to the line and its surroundings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Pattern:
    """A citation pattern: a regular expression (not anchored) and the root of its texts."""

    pattern: str
    root: str
    description: str = ""


def matched(citation: Column, patterns: list[Pattern]) -> Column:
    """Number of the first pattern that matches; null if none does."""
    out = None
    for k, p in enumerate(patterns):
        out = F.when(citation.rlike(p.pattern), k) if out is None else out.when(citation.rlike(p.pattern), k)
    return out if out is not None else F.lit(None).cast("int")


def resolve(citations: DataFrame, texts: DataFrame, patterns: list[Pattern], context: int = 0) -> DataFrame:
    """pattern, vendor_root, file, line, line_text, context, context_line for each citation that resolves.

    Two layouts are tried: the path below the root, and the same without its first part; the second
    only if the first doesn't exist at all.  A line that the file found doesn't have gives no row, and
    neither does a path that leaves its root.  ``texts`` is path, text; which files exist is told from
    the paths alone, only the texts that are cited are split, and the window is cut within the row.
    """
    k = matched(F.col("citation"), patterns)
    names, roots = F.array(*(F.lit(p.pattern) for p in patterns)), F.array(*(F.lit(p.root.rstrip("/")) for p in patterns))
    asked = citations.select("citation").distinct().withColumn("k", k).where("k is not null")
    asked = asked.select("citation", F.get(names, "k").alias("pattern"), F.get(roots, "k").alias("vendor_root"), T.cite_path(F.col("citation")).alias("p"), T.cite_line(F.col("citation")).alias("line")).where(T.safe_path(F.col("p")) & F.col("line").isNotNull())
    layouts = "array(concat_ws('/', vendor_root, p), concat_ws('/', vendor_root, regexp_replace(p, '^[^/]*/', '')))"
    tried = asked.selectExpr("*", f"posexplode({layouts}) as (ordinal, path)")
    chosen = tried.join(texts.select("path"), "path", "left_semi").groupBy("citation", "pattern", "vendor_root", "line").agg(F.min_by("path", "ordinal").alias("path"))
    lines = chosen.join(texts, "path").withColumn("lines", F.split("text", "\n")).where(F.col("line") <= F.size("lines"))
    return lines.select(
        "citation", "pattern", "vendor_root", F.col("path").alias("file"), "line", F.get("lines", F.col("line") - 1).alias("line_text"),
        T.window(F.col("lines"), F.col("line"), context).alias("context"), F.greatest(F.col("line") - context, F.lit(1)).alias("context_line"),
    )
