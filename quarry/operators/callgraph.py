"""Call graphs: class-hierarchy and rapid-type analysis, callers, callees, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import fixpoint
from ..plans.storage import keep
from .implements import implementers

EDGE = ("caller", "callee", "file", "line", "col")
ORDER = ("callee", "caller", "file", "line", "col")
ROOT = "<root>"
COMPACT = 8  # rounds after which the tables of earlier ones are made one


def targets(facts: dict[str, DataFrame]) -> DataFrame:
    """iface_type_id, method, signature, type_id, callee: what each interface method that is called may run, by type."""
    asked = facts["dyn_sites"].select("iface_type_id", "method", "signature").distinct()
    ifaces = asked.select(F.col("iface_type_id").alias("type_id")).distinct()
    wanted = facts["iface_methods"].join(ifaces, "type_id", "left_semi")
    named = wanted.select("name", "signature").unionByName(asked.select(F.col("method").alias("name"), "signature")).distinct()
    held = keep(facts["method_sets"].join(named, ["name", "signature"], "left_semi"), "methods")
    found = implementers(held, wanted, facts["named_types"], ifaces)
    methods = held.select("type_id", F.col("name").alias("method"), "signature", F.col("fn_qname").alias("callee"))
    return asked.join(found.withColumnRenamed("iface", "iface_type_id"), "iface_type_id").join(methods, ["type_id", "method", "signature"]).distinct()


def dynamic_edges(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges of interface calls: the methods that ``runs`` (of ``targets``) gives for each site."""
    return sites.join(runs, ["iface_type_id", "method", "signature"]).select(*EDGE).distinct()


def calls(facts: dict[str, DataFrame]) -> DataFrame:
    """Direct calls, as often as the facts have them: enough where only reachability is asked."""
    return facts["call_edges"].select(F.coalesce("caller", F.lit(ROOT)).alias("caller"), "callee", "file", "line", "col")


def static_edges(facts: dict[str, DataFrame]) -> DataFrame:
    """Direct calls, each once."""
    return calls(facts).distinct()


def value_edges(sites: DataFrame, values: DataFrame) -> DataFrame:
    """Calls of function values: each site may call any function of its signature that is taken as a value."""
    return sites.join(values.select("signature", F.col("fn").alias("callee")).distinct(), "signature").select(F.coalesce("caller", F.lit(ROOT)).alias("caller"), "callee", "file", "line", "col").distinct()


def cha(facts: dict[str, DataFrame]) -> DataFrame:
    """All edges: static ones, those of every type that satisfies the interface called, and of every function value."""
    return static_edges(facts).unionByName(dynamic_edges(facts["dyn_sites"], targets(facts))).unionByName(value_edges(facts["func_sites"], facts["func_values"])).distinct()


def rta(facts: dict[str, DataFrame], entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, reachable functions) from ``entries`` (node).

    A fixpoint over three gains: reachable functions instantiate types and take function values;
    instantiated types give interface calls their targets; taken values give calls of values theirs.
    What doesn't change (calls, sites, targets) is written once; each round joins it with new functions,
    types and values only, and writes those.  Values taken outside functions count from the start.
    The edges are put together once, at the end.
    """
    static, sites, runs = keep(calls(facts), "rta-calls"), keep(facts["dyn_sites"], "rta-sites"), keep(targets(facts), "rta-targets")
    uses = keep(facts["func_sites"], "rta-uses")
    # What a function brings about: types that it makes, values that it takes.
    made = facts["instantiations"].select("fn", "type_id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("signature"))
    brought = made.unionByName(facts["func_values"].select(F.col("taker").alias("fn"), F.lit(None).cast("string").alias("type_id"), F.col("fn").alias("value"), "signature"))
    brought = keep(brought.distinct(), "rta-brought")
    alive = not runs.isEmpty() or not uses.isEmpty()
    fresh = keep(entries.select("node").distinct(), "rta-fn")
    functions, gains = [fresh], []

    def of(df: DataFrame, nodes: DataFrame, key: str = "caller") -> DataFrame:
        return df.join(nodes, F.col(key) == F.col("node"), "left_semi")

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    def gained(nodes: DataFrame, by: DataFrame) -> DataFrame:
        """Edges of interface calls and of values from some functions, by some types and values."""
        types, values = by.select("type_id").where("type_id is not null").distinct(), by.where("value is not null").select(F.col("value").alias("fn"), "signature")
        return dynamic_edges(of(sites, nodes), runs.join(types, "type_id", "left_semi")).unionByName(value_edges(of(uses, nodes), values))

    while True:
        found = of(static, fresh).select("callee")
        if alive:
            new = of(brought, fresh, "fn")
            gains.append(keep(new if gains else new.unionByName(brought.where("fn is null")), "rta-gain"))
            found = found.unionByName(gained(fresh, union(gains)).select("callee"))
            if len(functions) > 1:
                found = found.unionByName(gained(union(functions[:-1]), gains[-1]).select("callee"))
        fresh = keep(found.select(F.col("callee").alias("node")).distinct().join(union(functions), "node", "left_anti"), "rta-fn")
        if fresh.isEmpty():
            break
        functions.append(fresh)
        for parts, name in ((functions, "rta-fn"), (gains, "rta-gain")):
            if len(parts) > COMPACT:  # the newest stays apart: it is the frontier
                parts[:-1] = [keep(union(parts[:-1]), name)]
    reached = union(functions)
    edges = of(static, reached).select(*EDGE)
    return (edges.unionByName(gained(reached, union(gains))) if gains else edges).distinct(), reached


def functions_by_qname(functions: DataFrame) -> DataFrame:
    """qname, n, fn_ids: the functions of each qualified name (variants of a package's build), synthetic ones left out."""
    rows = functions.where(~F.col("synthetic")).select("qname", "fn_id").distinct()
    return rows.groupBy("qname").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("fn_id")).alias("fn_ids"))


def edges_of_variants(functions: DataFrame, edges: DataFrame, qname: str) -> DataFrame:
    """Edges from any variant of a function: the union over its fn_ids, each edge once."""
    own = functions.where((F.col("qname") == qname) & ~F.col("synthetic")).select(F.col("fn_id").alias("caller")).distinct()
    return edges.join(own, "caller", "left_semi").select("callee", "file", "line", "col").distinct()


def missing_entries(functions: DataFrame, entries: DataFrame) -> DataFrame:
    """The asked entry points (node) that are no function of the graph."""
    return entries.join(functions.select(F.col("qname").alias("node")).distinct(), "node", "left_anti")


def callers(edges: DataFrame, qname: str) -> DataFrame:
    return edges.where(F.col("callee") == qname).select(*EDGE).distinct().orderBy(*ORDER)


def callees(edges: DataFrame, qname: str) -> DataFrame:
    """Direct callees only."""
    return edges.where(F.col("caller") == qname).select(*EDGE).distinct().orderBy(*ORDER)


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """node, depth of everything reachable from ``starts`` (node)."""
    return fixpoint.reach(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), starts, max_rounds).select("node", "depth")


def trace(edges: DataFrame, target: str, entries: list[str]) -> list[dict]:
    """Shortest call path from the first entry that has one to the target, as edges; empty if there is none.

    One search backwards from the target tells which entries have a path; one search forwards from the
    first of them, among the functions that the first search saw, finds it.
    """
    spark = edges.sparkSession
    links = keep(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "file", "line", "col"), "trace-links")
    aim = spark.createDataFrame([(target,)], "node string")
    asked = spark.createDataFrame([(e, k) for k, e in enumerate(entries)], "node string, ordinal int")
    callers = asked.join(links.select(F.col("src").alias("node")), "node", "left_semi").orderBy("ordinal").limit(1)  # the first that calls anything
    back = fixpoint.reach(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), aim, stop=callers, kept=True).select("node")
    first = asked.join(back, "node", "left_semi").orderBy("ordinal").first()
    if first is None or first.node == target:
        return []
    inner = links.join(back.select(F.col("node").alias("src")), "src", "left_semi")
    reached = fixpoint.reach(inner, spark.createDataFrame([(first.node,)], "node string"), stop=aim)
    return [{"caller": p["src"], "callee": p["dst"], "file": p["file"], "line": p["line"], "col": p["col"]} for p in fixpoint.path_to(reached, aim)]


def import_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """pkg_path, depth: the roots (pkg_path) and all they import, directly or not."""
    edges = imports.select(F.col("src_pkg").alias("src"), F.col("dst_pkg").alias("dst")).distinct()
    return fixpoint.reach(edges, roots.select(F.col("pkg_path").alias("node"))).select(F.col("node").alias("pkg_path"), "depth")
