"""Text windows, clipping, paths and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC_CAP, LIST_CAP = 16 << 10, 32 << 10


def clip(text: Column, cap: int, marker: str = "\n… output clipped …\n") -> Column:
    """Text of more than ``cap`` characters: half of the cap from either end around a marker."""
    half = cap // 2
    return F.when(F.length(text) > cap, F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def cite_path(citation: Column) -> Column:
    """The citation without a trailing ``:line``."""
    return F.regexp_replace(citation, r":[0-9]+\z", "")


def cite_line(citation: Column) -> Column:
    """The trailing line number; null if there is none or it isn't at least 1."""
    line = F.regexp_extract(citation, r":([0-9]+)\z", 1).try_cast("int")
    return F.when(line >= 1, line)


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root."""
    rises = F.split(path, "/")
    depth = F.aggregate(
        rises,
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda s, part: F.struct(
            (s["d"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("d"),
            (s["ok"] & ((s["d"] + F.when(part == "..", -1).otherwise(0)) >= 0)).alias("ok"),
        ),
        lambda s: s["ok"],
    )
    return ~path.startswith("/") & depth & (path != "")


#: MIME types by lower-case extension.
MIME = {".md": "text/markdown", ".yaml": "application/yaml", ".yml": "application/yaml", ".json": "application/json", ".go": "text/x-go", ".proto": "text/plain"}


def mime(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    out = None
    for suffix, kind in MIME.items():
        out = F.when(extension == suffix, kind) if out is None else out.when(extension == suffix, kind)
    return out.otherwise("text/plain")


def relative(path: Column, root: str) -> Column:
    """Path below ``root``, or unchanged if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def split_list(text: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def window(lines: Column, line: Column, context: int) -> Column:
    """The lines from ``context`` before to ``context`` after a line, clamped to the text, joined by breaks."""
    first = F.greatest(line - context, F.lit(1))
    return F.array_join(F.slice(lines, first, F.least(line + context, F.size(lines)) - first + 1), "\n")


def offset(lines: Column, line: Column, col: Column) -> Column:
    """Byte offset of a position in a text of these lines, clamped to it; null for a line that it doesn't have.

    Columns below 1 count as 1.  Only the text before the line and its end are measured, once.
    """
    before = F.when(line > 1, F.octet_length(F.array_join(F.slice(lines, 1, F.greatest(line - 1, F.lit(0))), "\n")) + 1).otherwise(0)
    size = F.octet_length(F.array_join(lines, "\n"))
    return F.when((line >= 1) & (line <= F.size(lines)), F.least(before + F.greatest(col, F.lit(1)) - 1, size))


def absolute(path: Column, root: str) -> Column:
    """A relative path below ``root``; an absolute one unchanged."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))

