"""Breadth-first reachability over an edge table, and paths from its parent pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep


COMPACT = 8  # rounds after which the names seen are written as one table


def reach(edges: DataFrame, start: DataFrame, max_rounds: int | None = None, stop: DataFrame | None = None, kept: bool = False) -> DataFrame:
    """node, depth, and the parent edge (``parent`` with the other edge columns) of all reachable nodes.

    ``edges`` has src, dst and further columns; of the edges by which a node is first reached the
    smallest (by src, then the further columns) is its parent.  ``start`` has node.  The loop ends on
    an empty frontier, after ``max_rounds``, or once a node of ``stop`` is reached.  The edges are written
    once, unless they are a written table (``kept``); a round moves only the frontier and the names seen.
    """
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    edges = edges if kept else keep(edges, "reach-edges")
    parent = F.struct(F.col("src"), *(F.col(c) for c in extra))
    blank = F.lit(None).cast(edges.select(parent.alias("p")).schema["p"].dataType)
    frontier = keep(start.select("node").distinct().withColumn("depth", F.lit(0)).withColumn("parent", blank), "reach")
    rounds, seen = [frontier], [frontier.select("node")]
    while not frontier.isEmpty() and (max_rounds is None or len(rounds) <= max_rounds):
        if stop is not None and not frontier.join(stop, "node", "left_semi").isEmpty():
            break
        if len(seen) > COMPACT:
            seen = [keep(reduce(DataFrame.unionByName, seen), "seen")]
        hop = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min(parent).alias("parent"))
        fresh = hop.join(reduce(DataFrame.unionByName, seen), "node", "left_anti").select("node", F.lit(len(rounds)).alias("depth"), "parent")
        frontier = keep(fresh, "reach")
        rounds.append(frontier)
        seen.append(frontier.select("node"))
    return reduce(DataFrame.unionByName, rounds)


def path_to(reached: DataFrame, targets: DataFrame) -> list[dict]:
    """Edges of the shortest path from a start to one of ``targets`` (node), first edge first; empty if none.

    Looks up one parent for each step, from the nearest target (ties: smallest name) backwards.
    """
    hit = reached.join(targets, "node", "left_semi").orderBy("depth", "node").first()
    out: list[dict] = []
    while hit is not None and hit.depth:
        step = hit.parent.asDict()
        out.append({"dst": hit.node, **step})
        hit = reached.where((F.col("node") == step["src"]) & (F.col("depth") == hit.depth - 1)).first()
    return out[::-1]
