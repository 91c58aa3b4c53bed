"""Facts of Go source trees.

Two distributed passes.  The first parses each file and summarises its declarations.  The second
takes each package together with the summaries of all packages it imports, directly or not, and
resolves its names and types; it is a grouped map, so memory follows one package and what it reaches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import globs
from ..plans.storage import keep


@dataclass(frozen=True)
class Root:
    """A module's folder: paths below it are packages of ``prefix`` (its module path; empty for the standard library)."""

    folder: str
    prefix: str = ""
    main: bool = False
    indirect: bool = False

    @property
    def module(self) -> str | None:
        return self.prefix or None


_CHECKED = ("symbols", "idents", "uses", "named_types", "method_sets", "iface_methods", "ast_nodes", "struct_fields", "functions", "call_edges", "dyn_sites", "instantiations", "func_values", "func_sites")
_SKIP = r"(^|/)(vendor|testdata|node_modules|\.[^/]*|_[^/]*)/"


def module_of(spark: SparkSession, folder: str) -> str:
    """Module path of ``go.mod`` in the folder; empty if there is none."""
    from ..operators.resources import module_path

    try:
        texts = spark.read.text(f"{folder}/go.mod", wholetext=True).select(F.lit("go.mod").alias("path"), F.col("value").alias("text"))
        found = module_path(texts).first()
    except Exception as e:  # no such file: the tree is not a module
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    return found.module if found else ""


def read_files(spark: SparkSession, root: Root, n: int = 0) -> DataFrame:
    """path (absolute), rel, text and module columns of a root's Go files; skipped folders are left out."""
    base = root.folder.rstrip("/")
    rows = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.go")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    rows = rows.select(path.alias("path"), F.col("value").alias("text"))
    rows = rows.withColumn("rel", F.expr(f"substring(path, {len(base.removeprefix('file://')) + 2})"))
    rows = rows.where(~F.col("rel").rlike(_SKIP))
    return rows.select("path", "rel", "text", F.lit(root.prefix).alias("prefix"), F.lit(root.module).alias("module_path"), F.lit(root.main).alias("module_main"), F.lit(root.indirect).alias("module_indirect"), F.lit(n).alias("root"))


def _parse(tags: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .golang import lexer, parser, summary

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not lexer.builds(r.rel, r.text, tags):
                    continue
                folder = r.rel.rpartition("/")[0]
                pkg = "/".join(x for x in (r.prefix, folder) if x)
                try:
                    tree = parser.parse(r.text)
                except lexer.SyntaxFault as e:
                    out.append((r.path, pkg, r.rel, r.text, False, [], "", str(e)))
                    continue
                test = r.rel.endswith("_test.go")
                if test and tree.name.endswith("_test"):
                    pkg += "_test"
                out.append((r.path, pkg, r.rel, r.text, test, sorted({i.path for i in tree.imports}), json.dumps(summary.summarise(tree, pkg)), ""))
            yield pd.DataFrame(out, columns=["path", "pkg_path", "rel", "text", "is_test", "imports", "summary", "fault"])

    return run


_PARSED = "path string, pkg_path string, rel string, text string, is_test boolean, imports array<string>, summary string, fault string"


def _check(group: pd.DataFrame) -> pd.DataFrame:
    """Fact rows of one package: its files have a text, those of packages it reaches only a summary."""
    from .golang import checker, parser

    summaries: dict = {}
    for r in group.sort_values("path").itertuples(index=False):
        if r.summary:
            summaries.setdefault(r.of_pkg, []).append((r.path, json.loads(r.summary)))
    world, out = checker.World(summaries), []
    for r in group[group["own"]].sort_values("path").itertuples(index=False):
        if r.summary:
            checker.check(world, r.pkg_path, r.path, parser.parse(r.text), int(r.tier_rank), int(r.load_order), lambda table, row: out.append((table, json.dumps(row))))
    return pd.DataFrame(out, columns=["table", "row"])


def source_facts(spark: SparkSession, roots: list[Root], tags: list[str] | None = None, tiers: tuple[int, ...] | None = None) -> dict[str, DataFrame]:
    """All fact tables of the roots' packages.

    ``tiers`` (all by default) are those whose symbols are indexed; uses and syntax are kept for all.
    Files that don't parse are listed in ``faults`` and contribute no other facts.
    """
    files = None
    for k, root in enumerate(roots):
        own = read_files(spark, root, k)
        files = own if files is None else files.unionByName(own)
    meta = files.select("path", "module_path", "module_main", "module_indirect", "root")
    parsed = keep(files.mapInPandas(_parse(frozenset(tags or ())), _PARSED), "parsed")
    placed = parsed.join(meta, "path")

    first = F.min_by(F.struct("module_path", "module_main", "module_indirect", "root"), F.struct("root", "path")).alias("m")
    packages = placed.groupBy("pkg_path").agg(first, F.max("is_test").alias("tested"), F.max(~F.col("is_test")).alias("plain"))
    rank = globs.tier_of(F.col("m.module_path"), F.col("m.module_main"), F.col("m.module_indirect"), "")
    packages = packages.withColumn("tier_rank", rank).withColumn("load_order", F.row_number().over(Window.orderBy(F.col("m.root"), "pkg_path")))
    packages = keep(packages.select("pkg_path", F.when(F.col("plain"), "regular").otherwise("test").alias("variant"), "m.module_path", "m.module_main", "m.module_indirect", globs.tier_label(F.col("tier_rank")).alias("tier"), "tier_rank", "load_order"), "packages")

    imports = parsed.select(F.col("pkg_path").alias("src_pkg"), F.explode("imports").alias("dst_pkg")).distinct().withColumn("alias", F.lit(""))
    imports = keep(imports, "imports")
    known = packages.select("pkg_path")
    internal = imports.join(known, F.col("dst_pkg") == F.col("pkg_path"), "left_semi")
    reached = keep(_closure(internal, known), "reached")

    ranks = packages.select("pkg_path", "tier_rank", "load_order")
    mine = parsed.select("pkg_path", F.col("pkg_path").alias("of_pkg"), F.lit(True).alias("own"), "path", "text", "summary").join(ranks, "pkg_path")
    theirs = parsed.where(~F.col("is_test")).select(F.col("pkg_path").alias("of_pkg"), "path", "summary").join(reached, "of_pkg")
    theirs = theirs.select("pkg_path", "of_pkg", F.lit(False).alias("own"), "path", F.lit(None).cast("string").alias("text"), "summary", F.lit(0).alias("tier_rank"), F.lit(0).alias("load_order"))
    rows = keep(mine.unionByName(theirs).groupBy("pkg_path").applyInPandas(_check, "table string, row string"), "checked", "table")

    facts: dict[str, DataFrame] = {"packages": packages, "imports": imports}
    for table in _CHECKED:
        schema = model.SCHEMAS[table]
        facts[table] = rows.where(F.col("table") == table).select(F.from_json("row", schema).alias("r")).select("r.*")
    symbols = facts["symbols"].withColumn("tier", globs.tier_label(F.col("tier_rank")))
    if tiers is not None:
        symbols = symbols.where(F.col("tier_rank").isin(*tiers))
        facts["named_types"] = facts["named_types"].where(F.col("tier_rank").isin(*tiers))
    from ..operators.symbols import deduplicate

    facts["symbols"] = keep(deduplicate(symbols), "symbols")
    facts["files"] = parsed.join(ranks, "pkg_path").select("path", "pkg_path", "is_test", F.size(F.split("text", "\n")).alias("n_lines"), "load_order")
    lines = parsed.select("path", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    facts["file_lines"] = lines.select("path", (F.col("p") + 1).alias("line"), "text")
    facts["texts"] = parsed.select("path", "text")
    facts["faults"] = parsed.where("fault <> ''").select("path", "fault")
    return facts


def _closure(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """pkg_path, of_pkg: each package with every package it reaches (itself not)."""
    edges = imports.select(F.col("src_pkg").alias("pkg_path"), F.col("dst_pkg").alias("of_pkg")).distinct()
    found = keep(edges, "closure")
    while True:
        longer = found.join(edges.select(F.col("pkg_path").alias("of_pkg"), F.col("of_pkg").alias("next")), "of_pkg").select("pkg_path", F.col("next").alias("of_pkg"))
        grown = keep(found.unionByName(longer).distinct(), "closure")
        if grown.count() == found.count():
            return found.where("pkg_path <> of_pkg")
        found = grown
