"""Symbol table: build, look up, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import globs, names

HIT = ("qname", "kind", "pkg_path", "file", "line", "tier")


def first_by(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row for each key: the first by ``order`` (or the last)."""
    by = [o.desc() for o in order] if last else order
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def deduplicate(symbols: DataFrame) -> DataFrame:
    """One symbol a qualified name: the highest tier wins, then the first loaded."""
    return first_by(symbols, ["qname"], [F.col("tier_rank").desc(), F.col("load_order")])


def flatten_packages(packages: DataFrame) -> DataFrame:
    """One package a path: the first loaded."""
    return first_by(packages, ["pkg_path"], [F.col("load_order")])


def file_map(files: DataFrame) -> DataFrame:
    """One entry a path: the last loaded."""
    return first_by(files, ["path"], [F.col("load_order")], last=True)


def classify(packages: DataFrame, own_module: str) -> DataFrame:
    """Packages with their tier."""
    rank = globs.tier_of(F.col("module_path"), F.col("module_main"), F.col("module_indirect"), own_module)
    return packages.withColumn("tier_rank", rank).withColumn("tier", globs.tier_label(rank))


def active_tiers(direct: bool | None = True, indirect: bool | None = False, stdlib: bool | None = False) -> tuple[int, ...]:
    """Tiers that are indexed: workspace always, direct unless switched off, the others if switched on."""
    chosen = [model.WORKSPACE]
    if direct is None or direct:
        chosen.append(model.DIRECT)
    if indirect:
        chosen.append(model.INDIRECT)
    if stdlib:
        chosen.append(model.STDLIB)
    return tuple(chosen)


def index(symbols: DataFrame, tiers: tuple[int, ...]) -> DataFrame:
    """Symbols of the active tiers; a partition filter on tier_rank where the table is so written."""
    return symbols.where(F.col("tier_rank").isin(*tiers))


def find(symbols: DataFrame, name: str, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """Hits by short name: exact without ``*``, else a glob.  An unknown kind has no hits."""
    rows = symbols.where(globs.in_scope(F.col("tier_rank"), scope)).where(globs.name_glob(F.col("sname"), name))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    return rows.select(*HIT)


def by_short_name(symbols: DataFrame) -> DataFrame:
    """sname, its qualified names in order, and their number."""
    return symbols.groupBy("sname").agg(F.array_join(F.sort_array(F.collect_set("qname")), ",").alias("qnames"), F.count("*").alias("n"))


def by_qname(symbols: DataFrame, qname: str) -> DataFrame:
    return symbols.where(F.col("qname") == names.strip_instantiation_text(qname))


def tier_breakdown(symbols: DataFrame) -> DataFrame:
    """tier, n in rank order; tiers without symbols don't appear."""
    return symbols.groupBy("tier_rank", "tier").agg(F.count("*").alias("n")).orderBy(F.desc("tier_rank")).select("tier", "n")
