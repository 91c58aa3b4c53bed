"""Engine queries over the driver's tables, each with its DuckDB SQL in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats, globs, names
from .functions import text as T
from .operators import callgraph, citations, implements, lint, proto, references, resources, syntax
from .operators import symbols as S
from .sources.driver_tables import DriverFacts
from .streaming import reload

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PATTERNS = [citations.Pattern(r"src1?5/[0-9]+", "vendor"), citations.Pattern(r"^src[0-9]+/", "vendor"), citations.Pattern(r"old/src", "vendor")]


def query(f: Callable[[DriverFacts], DataFrame]) -> Query:
    """Register ``f(facts)`` under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(DriverFacts(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return run


@query
def sym_exact(d):
    return S.find(d["symbols"], "red widget", scope="all")


@query
def sym_glob(d):
    return S.find(d["symbols"], "*e* bo*t", scope="all")


@query
def sym_prefix(d):
    return S.find(d["symbols"], "small*")


@query
def sym_kind(d):
    return S.find(d["symbols"], "*", kind="method", scope="all")


@query
def sym_scope(d):
    return S.find(d["symbols"], "*", scope="workspace+direct")


@query
def sym_tier_dedup(d):
    return S.deduplicate(d["symbols"]).select("qname", "obj_id", "tier", "load_order")


@query
def sym_by_name(d):
    return S.by_short_name(d["symbols"])


@query
def sym_index(d):
    """Symbols of the active tiers, after de-duplication."""
    return S.index(S.deduplicate(d["symbols"]), S.active_tiers(indirect=True)).select("qname", "tier")


@query
def tier_breakdown(d):
    return S.tier_breakdown(S.deduplicate(d["symbols"]))


@query
def pkg_classify(d):
    return S.classify(d["packages"].drop("tier", "tier_rank"), "example.com/r0").select("pkg_path", "tier", "tier_rank")


@query
def pkg_glob(d):
    return d["packages"].where(globs.package_glob(F.col("pkg_path"), "example.com/r1/...") | globs.package_glob(F.col("pkg_path"), "example.com/r2/n2")).select("pkg_path")


@query
def pkg_flatten(d):
    """First package of each path among the packages and a second, later variant of every other one."""
    p = d["packages"]
    more = p.where("load_order % 2 = 0").withColumns({"variant": F.lit("test"), "load_order": F.col("load_order") - 3})
    return S.flatten_packages(p.unionByName(more)).select("pkg_path", "variant", "load_order")


@query
def file_last(d):
    """The last symbol loaded of each file stands for the file map."""
    files = d["symbols"].select(F.col("file").alias("path"), "pkg_path", "load_order")
    return S.file_map(files).select("path", "pkg_path", "load_order")


@query
def refs_scope(d):
    return references.references(d["uses"], S.deduplicate(d["symbols"]), REF_TARGET, "example.com/r0/...", "workspace")


@query
def refs_all(d):
    return references.references(d["uses"], S.deduplicate(d["symbols"]), REF_TARGET, scope="all")


@query
def refs_limit(d):
    return references.limited(references.references(d["uses"], S.deduplicate(d["symbols"]), REF_TARGET, scope="all"), 5, ["file", "line", "col"])


@query
def refs_count(d):
    """Uses by symbol and tier of the using package: the whole join."""
    rows = d["uses"].join(d["symbols"].select("obj_id", "qname"), "obj_id")
    return rows.groupBy("qname", "tier_rank").agg(F.count("*").alias("n"))


REF_TARGET = "m/3.red widget"


@query
def definition_at(d):
    points = d["uses"].select("file", "line", (F.col("col") + 2).alias("col")).distinct()
    out = references.definition_at(d["idents"], d["symbols"], points)
    return out.select("at_file", "at_line", "at_col", "qname", "kind", "file", "line", "col")


@query
def implementations_all(d):
    """Every interface with every type that satisfies it."""
    types = d["named_types"]
    return implements.implementers(d["method_sets"], d["iface_methods"], types, types.where("is_interface"))


@query
def implements_structural(d):
    return implements.implementing_types(d, "example.com/r0/n0.I1", "example.com/r1/...", "all", loaded=True)


@query
def implements_indexed(d):
    """Types that satisfy, by way of the symbol table of all types."""
    t = d["named_types"].where("not is_interface")
    d["symbols"] = t.select(F.col("type_id").alias("obj_id"), F.lit("type").alias("kind"), "qname", F.substring_index("qname", ".", -1).alias("sname"), "pkg_path", "file", "line", "col", globs.tier_label(F.col("tier_rank")).alias("tier"), "tier_rank", F.col("line").alias("load_order"))
    return implements.implementations(d, "example.com/r0/n0.I0", scope="all")


@query
def ast_call(d):
    return syntax.calls(d["ast_nodes"], "m/*.red *", scope="workspace")


@query
def ast_call_nargs(d):
    return syntax.calls(d["ast_nodes"], "m/2*", 2, "example.com/...", "all")


@query
def ast_conv(d):
    return syntax.conversions(d["ast_nodes"], "*m/3.red widget", scope="all").unionByName(syntax.conversions(d["ast_nodes"], "m/4.small bolt", scope="all"))


@query
def ast_typeassert(d):
    return syntax.type_assertions(d["ast_nodes"], "*m/3.red widget", scope="all")


@query
def ast_dedup(d):
    """All calls, one a position."""
    return syntax.calls(d["ast_nodes"], "", scope="all")


@query
def html_links(d):
    """Structural match over markup: targets of links with their page."""
    pages = d.table("pages")
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n", "href"))


@query
def callers(d):
    return callgraph.callers(callgraph.static_edges(d), "p42")


@query
def callees(d):
    return callgraph.callees(callgraph.static_edges(d), "s7")


@query
def edge_dedup(d):
    """Distinct edges, counted by caller."""
    return callgraph.static_edges(d).groupBy("caller").agg(F.count("*").alias("n"), F.countDistinct("callee").alias("callees"))


@query
def two_hop(d):
    e = callgraph.static_edges(d).select("caller", "callee").distinct()
    a, b = e.toDF("src", "mid"), e.toDF("mid", "dst")
    return a.where("src = 'c1'").join(b, "mid").select("src", "dst").distinct()


@query
def reach_depth(d):
    """Every function reachable from c1 in a cyclic graph, with its distance."""
    return callgraph.reachable(callgraph.calls(d), d.spark.createDataFrame([("c1",)], "node string"))


@query
def reverse_trace(d):
    """Shortest call path from c1 to s33; of several, the one with the smallest callers."""
    path = callgraph.trace(callgraph.calls(d), "s33", ["nowhere", "c1"])
    rows = [(k, p["caller"], p["callee"], p["file"], p["line"], p["col"]) for k, p in enumerate(path)]
    return d.spark.createDataFrame(rows, "step int, caller string, callee string, file string, line int, col int")


@query
def cha_edges(d):
    return callgraph.cha(d).groupBy("caller").agg(F.count("*").alias("n"), F.countDistinct("callee").alias("callees"))


@query
def rta_reachable(d):
    return callgraph.rta(d, d.spark.createDataFrame([("c1",)], "node string"))[1]


@query
def rta_edges(d):
    edges = callgraph.rta(d, d.spark.createDataFrame([("s0",), ("s50",)], "node string"))[0]
    return edges.groupBy("caller").agg(F.count("*").alias("n"))


@query
def rta_missing(d):
    """Entry points that aren't functions of the graph."""
    asked = d.spark.createDataFrame([("c1",), ("zz",)], "node string")
    known = callgraph.static_edges(d).select(F.explode(F.array("caller", "callee")).alias("qname"))
    return callgraph.missing_entries(known, asked)


@query
def fn_variants(d):
    """Functions by qualified name."""
    return callgraph.functions_by_qname(d["functions"]).select("qname", "n", F.array_join("fn_ids", ",").alias("fn_ids"))


@query
def fn_variant_edges(d):
    """What the variants of one function call, each edge once."""
    return callgraph.edges_of_variants(d["functions"], callgraph.static_edges(d), "m/3.red widget")


@query
def value_edges(d):
    """Calls of function values, before any reachability."""
    return callgraph.value_edges(d["func_sites"], d["func_values"])


@query
def root_edges(d):
    """Edges of calls outside functions: those of the synthetic root."""
    calls = d["call_edges"].withColumn("caller", F.when(~F.col("caller").startswith("s"), F.col("caller")))
    return callgraph.static_edges({"call_edges": calls}).where(F.col("caller") == callgraph.ROOT).select("caller", "callee", "file", "line", "col")


@query
def exported_fields(d):
    f = d["struct_fields"]
    return f.select("obj_id", names.exported(F.col("go_field")).alias("upper"), names.exported(F.lower("go_field")).alias("lower"))


@query
def ref_texts(d):
    """The text of each symbol's list of references."""
    return d["uses"].groupBy("obj_id").agg(formats.place_list(F.col("file"), F.col("line"), F.col("col")).alias("text"))


@query
def edge_texts(d):
    e = callgraph.static_edges(d)
    return e.where("callee = 'p42'").select(formats.edge(*(F.col(c) for c in callgraph.EDGE)).alias("text"))


@query
def absolute_path(d):
    p = d["symbols"].select("obj_id", F.when(F.col("line") % 2 == 0, F.concat(F.lit("/"), "file")).otherwise(F.col("file")).alias("file"))
    return p.select("obj_id", T.absolute(F.col("file"), "/src/app/").alias("path"))


@query
def watch_folders(d):
    return reload.folders(d["fs_events"].where("op = 'create'").select("path").distinct())


@query
def tree_changes(d):
    """Changes between two listings of the documents: some removed, some new, some longer."""
    doc = d.table("documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("t"), F.octet_length("text").cast("long").alias("n"))
    before = doc.where("doc_id % 3 <> 0").select("path", "t", "n")
    after = doc.where("doc_id % 5 <> 0").select("path", "t", F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return reload.tree_changes(before, after).select("path", "op")


@query
def import_closure(d):
    return callgraph.import_closure(d["imports"], d["packages"].where("load_order = 2"))


@query
def cite_split(d):
    c = citations_of(d)
    return c.select("citation", T.cite_path(F.col("citation")).alias("path"), T.cite_line(F.col("citation")).alias("line"))


def citations_of(d):
    """Citations of lines of all documents: some in the second layout, some without a line or out of range."""
    doc = d.table("documents").select("doc_id", "source", F.size(F.split("text", "\n")).alias("n"))
    path = F.concat("source", F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return doc.select(
        F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old/"), path)).otherwise(path).alias("p"), (F.col("doc_id") % (F.col("n") + 1)).alias("l"), "doc_id",
    ).select(F.when(F.col("doc_id") % 11 == 0, F.col("p")).otherwise(F.concat("p", F.lit(":"), F.col("l"))).alias("citation"))


@query
def cite_line(d):
    return citations.resolve(citations_of(d), d["texts"], PATTERNS).select("citation", "pattern", "file", "line", "line_text")


@query
def cite_context(d):
    return citations.resolve(citations_of(d), d["texts"], PATTERNS, 2).select("citation", "context", "context_line")


@query
def line_window(d):
    """The window around line 3 of every text, within the row."""
    lines = F.split("text", "\n")
    return d.table("documents").select("doc_id", T.window(lines, F.lit(3), 1).alias("context")).where("context <> ''")


@query
def position_offset(d):
    """Byte offsets of (line, 4) in every text, clamped to it."""
    doc = d.table("documents").select("doc_id", F.split("text", "\n").alias("ls"))
    return doc.select("doc_id", T.offset(F.col("ls"), (F.col("doc_id") % 4).cast("int"), F.lit(4)).alias("byte")).where("byte is not null")


@query
def clip(d):
    return d.table("documents").select("doc_id", T.clip(F.col("text"), 200).alias("clipped"))


@query
def docs_clip(d):
    pages = d.table("pages").select(F.concat(F.lit("page/"), F.col("page_id")).alias("path"), F.col("html").alias("text"))
    return resources.documentation(pages, "page/7", 1000)


@query
def module_list(d):
    return resources.module_list(d["packages"])


@query
def module_paths(d):
    texts = d["packages"].select(F.concat("pkg_path", F.lit("/go.mod")).alias("path"), F.concat(F.lit("// m\nmodule  "), F.coalesce("module_path", F.lit("")), F.lit("\n\ngo 1.22\n")).alias("text"))
    return resources.module_path(texts)


@query
def mime(d):
    paths = d.table("pages").select(F.concat("url", F.element_at(F.array(*map(F.lit, (".md", ".GO", ".yaml", ".x", ""))), (F.col("page_id") % 5 + 1).cast("int"))).alias("path"))
    return paths.select("path", T.mime(F.col("path")).alias("mime"))


@query
def safe_path(d):
    p = d.table("part").select(F.element_at(F.array(*map(F.lit, ("a/../b", "../a", "/a", "a/./b/../../c", "a/../../b", "", "a//b/..", "x"))), (F.col("p_partkey") % 8 + 1).cast("int")).alias("base"), "p_partkey")
    p = p.select(F.when(F.col("base") == "", F.col("base")).otherwise(F.concat("base", F.lit("/"), F.col("p_partkey"))).alias("path"))
    return p.select("path", T.safe_path(F.col("path")).alias("safe"))


@query
def relative_path(d):
    return d["symbols"].select("obj_id", T.relative(F.col("file"), "example.com/r1").alias("path"))


@query
def resources_read(d):
    files = d.table("documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".md")).alias("path"), "text")
    declared = d.spark.createDataFrame([("docs/1.md",), ("docs/5.md",), ("docs/../docs/2.md",), ("../docs/3.md",)], "path string")
    return resources.read(files, declared)


@query
def split_list(d):
    texts = d.table("part").select("p_partkey", F.concat_ws(" , ", "p_name", F.lit(""), "p_type").alias("t"))
    return texts.select("p_partkey", F.array_join(T.split_list(F.col("t")), "|").alias("items"))


@query
def strip_names(d):
    q = d["symbols"].select("obj_id", F.concat(F.lit("(*"), "qname", F.lit("[int, map[string]T]).M")).alias("q"), F.concat("pkg_path", F.lit(" ["), "pkg_path", F.lit(".test]")).alias("p"))
    return q.select("obj_id", names.strip_instantiation(F.col("q")).alias("qname"), names.strip_test_suffix(F.col("p")).alias("pkg_path"))


@query
def qualify_names(d):
    s = d["symbols"]
    receiver = F.when(F.col("kind") == "method", F.concat(F.lit("T"), F.col("line")))
    return s.select("obj_id", names.qualify(F.col("pkg_path"), F.regexp_replace("sname", " ", "_"), receiver, F.col("line") % 2 == 0).alias("qname"))


@query
def hit_texts(d):
    s = d["symbols"]
    return s.select("obj_id", formats.symbol_hit(*(F.col(c) for c in ("file", "line", "tier", "kind", "qname"))).alias("hit"), formats.position(F.col("file"), F.col("line"), F.col("col")).alias("at"))


@query
def proto_fields(d):
    return proto.fields(d["struct_fields"]).drop("load_order", "obj_id")


@query
def proto_field(d):
    """The first field of each (message, proto name)."""
    rows = proto.fields(d["struct_fields"], "example.com/r0/...")
    return S.first_by(rows, ["proto_message", "proto_field"], [F.col("load_order")]).select("proto_message", "proto_field", "field_qname", "obj_id")


@query
def proto_xref(d):
    field = proto.field_of(proto.fields(d["struct_fields"]), "Msg0", "red_widget")
    return proto.uses_of(field, d["uses"])


@query
def lint_banned(d):
    found = lint.run(d, lint.build([("bannedinscope", {"banned": ["m/1.red *", "m/*.small bolt"], "scope_packages": ["example.com/r0/...", "example.com/r1/n1"]})]))
    return found


@query
def lint_all_scopes(d):
    found = lint.run(d, lint.build([("bannedinscope", {"banned": ["*.red widget"]})]), only=["bannedinscope"], package_glob="example.com/r2/...")
    return found.groupBy("file").agg(F.count("*").alias("n"), F.min("message").alias("message"))


@query
def watch_relevant(d):
    e = d["fs_events"]
    rows = e.where(reload.relevant(F.col("path"), F.col("op")) & reload.watched(F.col("path")))
    return rows.groupBy("path").agg(F.count("*").alias("n"))


@query
def reload_sessions(d):
    out = reload.sessions(d["fs_events"], "20 minutes")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), F.col("due").cast("timestamp_ntz").alias("due"), "n_events")


@query
def reload_stream(d):
    """The same by a stream over the table; each batch writes its whole state to the shared folder."""
    import uuid

    from .plans.storage import shared_folder

    spark = d.spark
    table = d.table("events")
    path = f"{d.sf_dir}/events.parquet"
    files = spark.readStream.schema(table.schema).parquet(f"{path}*")
    twin = DriverFacts(spark, d.sf_dir)
    twin.table = lambda name: files  # type: ignore[method-assign]
    folder = f"{shared_folder(spark)}/reloads-{uuid.uuid4().hex}"
    rows = reload.sessions(twin["fs_events"].withWatermark("ts", "10 seconds"), "20 minutes")
    written = []

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        written.append(number)

    rows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rows.schema).parquet(f"{folder}/batch-{max(written)}")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), F.col("due").cast("timestamp_ntz").alias("due"), "n_events")
