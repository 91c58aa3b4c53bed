"""Definition lookup and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs
from . import symbols as S


def references(uses: DataFrame, symbols: DataFrame, qname: str, package_glob: str = "", scope: str | None = None) -> DataFrame:
    """file, line, col of every use of exactly this object; empty if it isn't indexed."""
    target = S.by_qname(symbols, qname).select("obj_id")
    rows = uses.where(globs.in_loaded_scope(F.col("tier_rank"), scope)).where(globs.package_glob(F.col("pkg_path"), package_glob))
    return rows.join(target, "obj_id", "left_semi").select("file", "line", "col").distinct()


def limited(rows: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first ``limit`` rows by a total order (0: all), each with ``truncated``: whether the limit was met."""
    if limit <= 0:
        return rows.withColumn("truncated", F.lit(False))
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn("truncated", F.count("*").over(Window.partitionBy()) >= limit)  # of ``limit`` rows at most


def definition_at(idents: DataFrame, symbols: DataFrame, points: DataFrame) -> DataFrame:
    """For each point (file, line, col): the object of the innermost identifier there.

    Point-in-interval join on (file, line) with the column range; a point outside all identifiers has
    no row.  Where the object isn't in the symbol table (a local, a field, another tier), the identifier
    that defines it answers, and without one the identifier itself.
    """
    p = points.select(F.col("file").alias("pf"), F.col("line").alias("pl"), F.greatest(F.col("col"), F.lit(1)).alias("pc"))
    inside = idents.join(p, (F.col("file") == F.col("pf")) & (F.col("line") == F.col("pl")) & (F.col("col") <= F.col("pc")) & (F.col("pc") < F.col("end_col")))
    span = F.struct((F.col("end_col") - F.col("col")).alias("w"), F.col("col").alias("c"), F.col("obj_id").alias("o"))
    what = F.struct("obj_id", "qname", "kind", "file", "line", "col")
    inner = inside.groupBy("pf", "pl", "pc").agg(F.min_by(what, span).alias("i"))
    sym = symbols.select(F.col("obj_id").alias("so"), *(F.col(c).alias(f"s_{c}") for c in ("qname", "kind", "file", "line", "col")))
    defined = idents.where("is_def").groupBy(F.col("obj_id").alias("do")).agg(F.min(F.struct("file", "line", "col")).alias("d"))
    joined = inner.join(sym, F.col("i.obj_id") == F.col("so"), "left").join(defined, F.col("i.obj_id") == F.col("do"), "left")
    return joined.select(
        F.col("pf").alias("at_file"), F.col("pl").alias("at_line"), F.col("pc").alias("at_col"),
        *(F.coalesce(F.col(f"s_{c}"), *([F.col(f"d.{c}")] if c in ("file", "line", "col") else []), F.col(f"i.{c}")).alias(c) for c in ("qname", "kind", "file", "line", "col")),
    )
