"""Globs, texts, fixpoints and the reload stream by themselves."""

import fnmatch
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry import model
from quarry.functions import globs, names
from quarry.functions import text as T
from quarry.operators import callgraph, implements, references
from quarry.operators import symbols as S
from quarry.plans import fixpoint
from quarry.sources.golang.lexer import SyntaxFault, builds, tokens
from quarry.sources.golang.parser import parse
from quarry.streaming import reload


def test_name_globs(spark):
    words = ["", "a", "ab", "abc", "xabc", "a.b", "a.bc", "a\nb", "ab\n", "a*b", "a\\Eb", "A"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for g in ("a", "a*", "*b", "*b*", "a*c", "a.b", "*", "a\\E*", "*.*", "**", "a*b*c"):
        want = {w for w in words if re.fullmatch(".*".join(map(re.escape, g.split("*"))), w)}
        assert {r.w for r in df.where(globs.name_glob(F.col("w"), g)).collect()} == want, g
    assert df.where(globs.name_glob(F.col("w"), "")).count() == len(words)
    assert fnmatch.fnmatchcase("abc", "a*")


def test_prefix_globs_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.concat(F.lit("n"), "id").alias("sname")).write.parquet(f"{tmp_path}/s")
    df = spark.read.parquet(f"{tmp_path}/s")
    for g, pushed in (("n3", "EqualTo(sname,n3)"), ("n3*", "StringStartsWith(sname,n3)"), ("n*3", "StringStartsWith(sname,n)")):
        assert pushed in df.where(globs.name_glob(F.col("sname"), g))._jdf.queryExecution().toString()


def test_package_globs(spark):
    paths = ["p", "p/q", "p/q/r", "pq", ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for g, want in (("", set(paths)), ("...", set(paths)), ("p/...", {"p", "p/q", "p/q/r"}), ("p", {"p"}), ("p/q/...", {"p/q", "p/q/r"})):
        assert {r.p for r in df.where(globs.package_glob(F.col("p"), g)).collect()} == want
        assert {r.p for r in df.where(globs.package_glob_column(F.col("p"), F.lit(g))).collect()} == want


def test_scopes(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "rank int")
    got = lambda c: {r["rank"] for r in df.where(c).collect()}
    assert got(globs.in_scope(F.col("rank"), None)) == got(globs.in_scope(F.col("rank"), "default")) == {3, 4}
    assert got(globs.in_scope(F.col("rank"), "all")) == {1, 2, 3, 4} and got(globs.in_loaded_scope(F.col("rank"), "all")) == {0, 1, 2, 3, 4}
    assert got(globs.in_loaded_scope(F.col("rank"), "workspace")) == {4}
    with pytest.raises(model.QueryError):
        globs.scope_ranks("everything")


def test_names(spark):
    cases = {"p.F[int]": "p.F", "(*p.T[int]).M": "(*p.T).M", "p.G[map[string]p.T[q]]": "p.G", "p.F": "p.F"}
    for q, want in cases.items():
        got = spark.range(1).select(names.strip_instantiation(F.lit(q)).alias("q")).first().q
        assert got == want == names.strip_instantiation_text(q)


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(T.clip(F.lit("abcdefghij"), 4, "|")) == "ab|ij" and one(T.clip(F.lit("abcd"), 4)) == "abcd"
    assert one(T.clip(F.lit("é" * 10), 4, "|")) == "éé|éé"
    for p, ok in {"a/b": True, "../a": False, "/a": False, "a/../..": False, "a/../b": True, "": False, "a/../../b/c": False}.items():
        assert one(T.safe_path(F.lit(p))) is ok, p
    assert one(T.cite_line(F.lit("a:b:12"))) == 12 and one(T.cite_path(F.lit("a:b:12"))) == "a:b"
    assert one(T.cite_line(F.lit("a:0"))) is None and one(T.cite_line(F.lit("a:99999999999"))) is None and one(T.cite_line(F.lit("a"))) is None
    lines = F.array(*map(F.lit, "abc"))
    assert [one(T.window(lines, F.lit(k), 1)) for k in (1, 2, 3)] == ["a\nb", "a\nb\nc", "b\nc"]
    assert one(F.array_join(T.split_list(F.lit(" a, ,b ,")), "|")) == "a|b"
    assert one(T.relative(F.lit("/r/x"), "/r/")) == "x" and one(T.relative(F.lit("/rx"), "/r")) == "/rx"
    assert [one(T.mime(F.lit(p))) for p in ("A.MD", "x.yml", "d.go/x", "m.proto")] == ["text/markdown", "application/yaml", "text/plain", "text/plain"]


def test_reach_and_paths_are_shortest(spark):
    r = random.Random(6)
    edges = list({(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(70)})
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "src string, dst string, k int")
    depth, frontier = {"n0": 0}, ["n0"]
    while frontier:
        frontier = sorted({b for a, b in edges if a in frontier} - set(depth))
        depth |= {n: max(depth.values()) + 1 for n in frontier}
    reached = fixpoint.reach(df, spark.createDataFrame([("n0",)], "node string"))
    assert {x.node: x.depth for x in reached.collect()} == depth
    for target in list(depth)[-3:]:
        path = fixpoint.path_to(reached, spark.createDataFrame([(target,)], "node string"))
        assert len(path) == depth[target]
        assert all((p["src"], p["dst"]) in edges for p in path) and all(a["dst"] == b["src"] for a, b in zip(path, path[1:]))
    assert fixpoint.path_to(reached, spark.createDataFrame([("nowhere",)], "node string")) == []
    assert fixpoint.reach(df, spark.createDataFrame([("n0",)], "node string"), max_rounds=1).agg({"depth": "max"}).first()[0] == 1


def test_limit_and_truncation(spark):
    df = spark.range(5).toDF("a")
    for limit, n, cut in ((0, 5, False), (9, 5, False), (5, 5, True), (2, 2, True)):
        rows = references.limited(df, limit, ["a"]).collect()
        assert len(rows) == n and all(x.truncated is cut for x in rows)
    assert references.limited(df.where("a > 9"), 3, ["a"]).count() == 0


def test_division(spark):
    sets = {"x": "ab", "y": "a", "z": "abc", "w": ""}
    wants = {"I": "ab", "J": "", "K": "d"}
    ms = spark.createDataFrame([(t, False, m, "s", m) for t, v in sets.items() for m in v], model.SCHEMAS["method_sets"])
    im = spark.createDataFrame([(i, m, "s") for i, v in wants.items() for m in v], model.SCHEMAS["iface_methods"])
    rows = [(t, t, "p", i, "f", 1, 1, 4) for t, i in [*((t, False) for t in sets), *((t, True) for t in wants)]]
    types = spark.createDataFrame(rows, model.SCHEMAS["named_types"])
    got = {(r.iface, r.type_id) for r in implements.implementers(ms, im, types, types.where("is_interface")).collect()}
    assert got == {(i, t) for i, v in wants.items() for t, s in sets.items() if set(v) <= set(s)}


def test_priority_dedupe(spark):
    rows = [("o1", "func", "q", 3, 2), ("o2", "func", "q", 4, 9), ("o3", "func", "q", 4, 5), ("o4", "func", "r", 1, 1)]
    df = spark.createDataFrame(rows, "obj_id string, kind string, qname string, tier_rank int, load_order int")
    assert {r.obj_id for r in S.deduplicate(df).collect()} == {"o3", "o4"}
    assert S.active_tiers() == (4, 3) and S.active_tiers(None, True, True) == (4, 3, 2, 1) and S.active_tiers(False) == (4,)


def test_unknown_caller_is_the_root(spark):
    facts = {"call_edges": spark.createDataFrame([(None, "f", "a.go", 1, 1, "static")], model.SCHEMAS["call_edges"])}
    assert callgraph.static_edges(facts).first().caller == "<root>"


EVENTS = [("a.go", "write", 0), ("pkg/b.go", "create", 100), ("go.mod", "write", 399), ("README.txt", "write", 400), (".x.go", "write", 450), ("x.go___jb_tmp___", "write", 500), ("x___jb_old.go", "write", 520), ("c.go", "chmod", 600), ("vendor/v.go", "write", 650), (".git/h.go", "write", 660), ("testdata/t.go", "write", 670), ("go.sum", "write", 5000), ("d.go", "write", 5301)]


def changes(spark):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(start + timedelta(milliseconds=ms), p, o) for p, o, ms in EVENTS], model.SCHEMAS["fs_events"])


def test_debounce(spark):
    got = [(r.started.microsecond // 1000 + r.started.second * 1000, r.n_events) for r in reload.sessions(changes(spark)).orderBy("started").collect()]
    assert got == [(0, 3), (5000, 1), (5301, 1)]


def test_reload_stream_calls_back_once_a_session(spark, tmp_path):
    changes(spark).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    end = datetime(2024, 1, 1, 1)
    seen = []
    source = spark.readStream.schema(model.SCHEMAS["fs_events"]).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = reload.reload_stream(source, lambda rows, n: seen.extend(r.n_events for r in rows.orderBy("started").collect()), f"{tmp_path}/cp")
    try:
        q.processAllAvailable()
        spark.createDataFrame([(end, "z.go", "write")], model.SCHEMAS["fs_events"]).coalesce(1).write.parquet(f"{tmp_path}/in/b")
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [3, 1, 1]  # the last session is still open


def test_go_syntax():
    assert [t.text for t in tokens("x := a\ny++ // c\n")][:-1] == ["x", ":=", "a", ";", "y", "++", ";"]
    assert [(t.text, t.col) for t in tokens('é := "ü" + b')][3:5] == [("+", 12), ("b", 14)]  # columns are bytes
    with pytest.raises(SyntaxFault):
        parse("package p\nfunc {")
    tree = parse("package p\nimport . \"a\"\ntype ( A = B; C[T ~int | string] struct { D; *e.F `t`; g, h int } )\nfunc (c *C[T]) m(a, b int, d ...string) (x int, err error) { for i := range 10 { if v := (A{}); v.x { continue } }; l: select { case y := <-ch: _ = y; default: }; switch { case 1 < 2: fallthrough; default: goto l }; return }\nvar z = map[string][]func(int) (a, error){}\n")
    assert [d.kind for d in tree.decls] == ["Type", "Type", "Func", "Var"]


def test_build_constraints():
    assert builds("a.go", "package a", frozenset()) and not builds("a_windows.go", "package a", frozenset()) and builds("a_linux_test.go", "package a", frozenset())
    for line, tags, want in (("x", "", False), ("x", "x", True), ("!x", "", True), ("x || linux", "", True), ("x && linux", "", False), ("!(x || y) && go1.20", "", True), ("x && (y || z)", "x z", True)):
        assert builds("a.go", f"// c\n\n//go:build {line}\n\npackage a", frozenset(tags.split())) is want, line


def test_function_values_count_where_they_are_taken(spark):
    """A value taken in dead code is no target of a reachable call; one taken outside functions always is."""
    make = lambda table, rows: spark.createDataFrame(rows, model.SCHEMAS[table])
    facts = {t: model.empty(spark, t) for t in ("dyn_sites", "method_sets", "iface_methods", "named_types", "instantiations")}
    facts["call_edges"] = make("call_edges", [("main", "run", "a.go", 1, 1, "static"), ("dead", "gone", "a.go", 2, 1, "static"), ("used", "late", "a.go", 3, 1, "static")])
    facts["func_sites"] = make("func_sites", [("run", "func()", "a.go", 4, 1), ("late", "func(int)", "a.go", 5, 1)])
    facts["func_values"] = make("func_values", [("main", "used", "func()"), ("dead", "unused", "func()"), (None, "outer", "func()"), ("late", "deep", "func(int)"), ("used", "never", "func(string)")])
    edges, reached = callgraph.rta(facts, spark.createDataFrame([("main",)], "node string"))
    assert {r.node for r in reached.collect()} == {"main", "run", "used", "outer", "late", "deep"}
    assert {(r.caller, r.callee) for r in edges.collect()} == {("main", "run"), ("run", "used"), ("run", "outer"), ("used", "late"), ("late", "deep")}
    assert ("run", "unused") in {(r.caller, r.callee) for r in callgraph.cha(facts).collect()}


def test_long_chains_are_reached(spark, monkeypatch):
    from quarry.plans import fixpoint

    monkeypatch.setattr(fixpoint, "COMPACT", 2)
    monkeypatch.setattr(callgraph, "COMPACT", 2)
    rows = [(f"n{k}", f"n{k + 1}", "a.go", k, 1, "static") for k in range(9)] + [("n9", "n0", "a.go", 9, 1, "static")]
    facts = {t: model.empty(spark, t) for t in ("dyn_sites", "method_sets", "iface_methods", "named_types", "instantiations", "func_sites", "func_values")}
    facts["call_edges"] = spark.createDataFrame(rows, model.SCHEMAS["call_edges"])
    start = spark.createDataFrame([("n0",)], "node string")
    assert {(r.node, r.depth) for r in callgraph.reachable(callgraph.static_edges(facts), start).collect()} == {(f"n{k}", k) for k in range(10)}
    assert callgraph.rta(facts, start)[1].count() == 10
    path = callgraph.trace(callgraph.static_edges(facts), "n3", ["nowhere", "n8", "n1"])
    assert [p["caller"] for p in path] == ["n8", "n9", "n0", "n1", "n2"]
    assert callgraph.trace(callgraph.static_edges(facts), "n3", ["n3"]) == [] and callgraph.trace(callgraph.static_edges(facts), "zz", ["n0"]) == []


def test_functions_of_a_name(spark):
    rows = [("f@a", "p.F", "regular", False), ("f@b", "p.F", "test", False), ("g", "p.G", "regular", False), ("w", "p.F", "regular", True)]
    df = spark.createDataFrame(rows, model.SCHEMAS["functions"])
    assert [tuple(r) for r in callgraph.functions_by_qname(df).orderBy("qname").collect()] == [("p.F", 2, ["f@a", "f@b"]), ("p.G", 1, ["g"])]
    edges = spark.createDataFrame([("f@a", "x", "a", 1, 1), ("f@b", "x", "a", 1, 1), ("f@b", "y", "a", 2, 1), ("w", "z", "a", 3, 1)], "caller string, callee string, file string, line int, col int")
    assert {r.callee for r in callgraph.edges_of_variants(df, edges, "p.F").collect()} == {"x", "y"}


def test_tree_is_followed(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "a.go").write_text("package a")
    (tree / "b.go").write_text("package b")
    before = spark.createDataFrame(reload.listing(spark, str(tree)).collect())
    (tree / "new" / "deep").mkdir(parents=True)
    (tree / "new" / "deep" / "c.go").write_text("package c")
    (tree / "b.go").write_text("package b // longer")
    (tree / "pkg" / "a.go").unlink()
    got = {(r.path, r.op) for r in reload.tree_changes(before, reload.listing(spark, str(tree))).collect()}
    assert got == {("new/deep/c.go", "create"), ("b.go", "write"), ("pkg/a.go", "remove")}
    paths = spark.createDataFrame([("new/deep/c.go",), ("vendor/x/y.go",), (".git/z",), ("d.go",)], "path string")
    assert {r.folder for r in reload.folders(paths).collect()} == {".", "new", "new/deep"}
    sink = str(tmp_path / "events")
    reload.follow(spark, str(tree), sink, 0.0, rounds=1)  # nothing changed
    assert not (tmp_path / "events").exists()
