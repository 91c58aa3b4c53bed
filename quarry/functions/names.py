"""Qualified names: ``pkg.Name``, ``(pkg.T).M``, ``(*pkg.T).M``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_instantiation(qname: Column) -> Column:
    """Without type arguments; bracket groups go wherever they stand, so ``(*p.T[int]).M`` keeps its method."""
    return F.regexp_replace(F.regexp_replace(qname, r"\[[^\[\]]*(\[[^\[\]]*\][^\[\]]*)*\]", ""), r"\[.*\z", "")


def strip_instantiation_text(qname: str) -> str:
    out, depth = [], 0
    for ch in qname:
        depth += ch == "["
        if not depth:
            out.append(ch)
        depth -= ch == "]"
    return "".join(out)


def strip_test_suffix(pkg_path: Column) -> Column:
    """Without the decoration of a test build (``p [p.test]``)."""
    return F.substring_index(pkg_path, " [", 1)


def qualify(pkg_path: Column, name: Column, receiver: Column | None = None, pointer: Column | None = None) -> Column:
    """Qualified name of an object or, with a receiver type, of a method; bare where there is no package."""
    own = strip_test_suffix(pkg_path)
    plain = F.when(pkg_path.isNull() | (pkg_path == ""), name).otherwise(F.concat_ws(".", own, name))
    if receiver is None:
        return plain
    typed = F.concat(F.lit("("), F.when(pointer, F.lit("*")).otherwise(F.lit("")), own, F.lit("."), receiver, F.lit(")."), name)
    return F.when(receiver.isNull(), plain).otherwise(typed)


def exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")
