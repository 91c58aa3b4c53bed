"""Structural search over syntax nodes: calls, type assertions, conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, names
from . import symbols as S

HIT = ("qname", "pkg_path", "file", "line", "col")


def _scoped(nodes: DataFrame, package_glob: str, scope: str | None) -> DataFrame:
    return nodes.where(globs.in_loaded_scope(F.col("tier_rank"), scope)).where(globs.package_glob(F.col("pkg_path"), package_glob))


def _one_a_position(hits: DataFrame) -> DataFrame:
    """Of nodes that begin at one position, the first in pre-order."""
    return S.first_by(hits, ["file", "line", "col"], [F.col("pkg_path"), F.col("visit_seq"), F.col("qname")]).select(*HIT)


def type_is(target: str, qname: Column, pointer: Column) -> Column:
    """``*pkg.T`` asks for a pointer, ``pkg.T`` for the named type itself."""
    target = names.strip_instantiation_text(target)
    return (qname == target.removeprefix("*")) & (pointer if target.startswith("*") else ~pointer)


def calls(nodes: DataFrame, func: str, n_args: int | None = None, package_glob: str = "", scope: str | None = None) -> DataFrame:
    """Calls by callee glob; ``n_args`` None doesn't regard the number of arguments.  Conversions count as calls."""
    rows = _scoped(nodes.where(F.col("kind") == "call"), package_glob, scope)
    if n_args is not None:
        rows = rows.where(F.col("n_args") == n_args)
    rows = rows.where(F.col("callee_qname").isNotNull() & globs.name_glob(F.col("callee_qname"), func))
    return _one_a_position(rows.withColumn("qname", F.col("callee_qname")))


def type_assertions(nodes: DataFrame, target: str, package_glob: str = "", scope: str | None = None) -> DataFrame:
    rows = _scoped(nodes.where(F.col("kind") == "typeassert"), package_glob, scope).where(type_is(target, F.col("target_qname"), F.col("target_is_ptr")))
    return _one_a_position(rows.withColumn("qname", F.lit(names.strip_instantiation_text(target))))


def conversions(nodes: DataFrame, target: str, package_glob: str = "", scope: str | None = None) -> DataFrame:
    rows = _scoped(nodes.where((F.col("kind") == "call") & (F.col("n_args") == 1) & F.col("fun_is_type")), package_glob, scope)
    rows = rows.where(type_is(target, F.col("target_qname"), F.col("target_is_ptr")))
    return _one_a_position(rows.withColumn("qname", F.lit(names.strip_instantiation_text(target))))
