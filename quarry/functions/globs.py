"""Globs and scopes as predicates that Parquet can prune on where possible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


def name_glob(name: Column, glob: str) -> Column:
    """``*`` stands for any run without line breaks, the rest for itself; empty matches all.

    Equality and literal prefixes are emitted as such, so they reach the scan.
    """
    if not glob:
        return F.lit(True)
    parts = glob.split("*")
    if len(parts) == 1:
        return name == glob
    head = name.startswith(parts[0]) if parts[0] else F.lit(True)
    if len(parts) == 2 and not parts[1]:
        return head & ~name.contains("\n")
    quoted = [r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" if p else "" for p in parts]
    return head & name.rlike("^" + ".*".join(quoted) + r"\z")


def package_glob(path: Column, glob: str) -> Column:
    """Empty or ``...``: all; ``p/...``: p and what is below; else the path itself."""
    if glob in ("", "..."):
        return F.lit(True)
    if glob.endswith("/..."):
        base = glob[:-4]
        return (path == base) | path.startswith(base + "/")
    return path == glob


def package_glob_column(path: Column, glob: Column) -> Column:
    """The same for globs in a column: a theta-join condition."""
    base = F.substring(glob, F.lit(1), F.length(glob) - 4)
    return glob.isin("", "...") | (glob.endswith("/...") & ((path == base) | path.startswith(F.concat(base, F.lit("/"))))) | (path == glob)


def scope_ranks(scope: str | None) -> tuple[int, ...]:
    """Tier ranks of a scope; empty and ``default`` are the default scope."""
    name = (scope or "").strip()
    if name in ("", "default"):
        name = model.DEFAULT_SCOPE
    if name not in model.SCOPES:
        raise model.QueryError(f"unknown scope {scope!r}: use {', '.join(model.SCOPES)}")
    return model.SCOPES[name]


def in_scope(rank: Column, scope: str | None) -> Column:
    return rank.isin(*scope_ranks(scope))


def in_loaded_scope(rank: Column, scope: str | None) -> Column:
    """For scans of syntax: ``all`` also takes packages of unknown tier."""
    ranks = scope_ranks(scope)
    return F.lit(True) if ranks == model.SCOPES["all"] else rank.isin(*ranks)


def tier_of(module: Column, main: Column, indirect: Column, own_module: Column | str) -> Column:
    """Tier rank of a package: no module is stdlib; the main module (or its path) is workspace; then direct, indirect."""
    own = F.lit(own_module) if isinstance(own_module, str) else own_module
    return (
        F.when(module.isNull(), model.STDLIB)
        .when(F.coalesce(main, F.lit(False)) | ((own != "") & (module == own)), model.WORKSPACE)
        .when(~F.coalesce(indirect, F.lit(False)), model.DIRECT)
        .otherwise(model.INDIRECT)
    )


def tier_label(rank: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, model.TIERS)), rank + 1), F.lit(model.TIERS[0]))
