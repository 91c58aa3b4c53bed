"""Result texts of the tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_hit(file: Column, line: Column, tier: Column, kind: Column, qname: Column) -> Column:
    return F.format_string("%s:%d  [%s %s]  %s", file, line, tier, kind, qname)


def position(file: Column, line: Column, col: Column) -> Column:
    return F.format_string("%s:%d:%d", file, line, col)


def place_list(file: Column, line: Column, col: Column, kind: str = "reference") -> Column:
    """Aggregate: the text of a list of places, a head line with their number first."""
    rows = F.sort_array(F.collect_list(F.struct(file.alias("f"), line.alias("l"), col.alias("c"))))
    return F.concat(F.count("*").cast("string"), F.lit(f" {kind}(s)\n"), F.array_join(F.transform(rows, lambda r: position(r["f"], r["l"], r["c"])), "\n"))


def edge(caller: Column, callee: Column, file: Column, line: Column, col: Column) -> Column:
    return F.concat(caller, F.lit(" -> "), callee, F.lit("  "), position(file, line, col))
