"""The tools over hand-written Go trees."""

from pathlib import Path

import pytest

from quarry import model
from quarry.operators import citations, lint
from quarry.sources import config as C
from quarry.sources.snapshots import Snapshots
from quarry.sources.source_tree import Root, module_of, source_facts
from quarry.tools import Tools

HERE = Path(__file__).parent / "fixtures"
SHOP, STD, DEP, GUARDED = (str(HERE / x) for x in ("shop", "std", "dep", "guarded"))
M = "example.com/shop"
ROOTS = [Root(SHOP, M, main=True), Root(DEP, "example.com/dep"), Root(STD)]


@pytest.fixture(scope="module")
def facts(spark):
    return source_facts(spark, ROOTS)


@pytest.fixture(scope="module")
def settings():
    return C.parse({
        "resources": [{"path": "notes/README.md", "title": "Notes"}, {"path": "../secret"}],
        "citations": [{"pattern": r"^lib/.*\.rs", "vendor_root": "third"}, {"pattern": r"\.rs:", "vendor_root": "third"}],
        "proto": [{"import": M + "/pkg/wire"}],
    })


@pytest.fixture(scope="module")
def tools(spark, facts, settings):
    return Tools(spark, dict(facts), settings, SHOP)


@pytest.fixture(scope="module")
def default(spark, facts, settings):
    """As indexed by default: workspace and direct dependencies only."""
    own = dict(facts)
    own["symbols"] = facts["symbols"].where("tier_rank >= 3")
    own["named_types"] = facts["named_types"].where("tier_rank >= 3")
    return Tools(spark, own, settings, SHOP)


def column(result, name):
    return [r[name] for r in result.rows]


def test_nothing_was_left_unparsed(facts):
    assert facts["faults"].count() == 0
    assert {r.pkg_path for r in facts["packages"].collect()} == {M, M + "/pkg/bottom", M + "/pkg/wire", "example.com/dep/kit", "fmt", "testing", "time", "os"}
    assert not {"onlyThere", "tagged"} & {r.sname for r in facts["symbols"].collect()}
    assert facts["uses"].where("not resolved").count() == 0


def test_find_symbol(tools, default):
    assert [(r["qname"], r["kind"], r["pkg_path"], r["tier"]) for r in tools.find_symbol("Label").rows] == [(M + ".Label", "func", M, "workspace")]
    assert column(tools.find_symbol("Add", kind="method"), "qname") == [f"(*{M}.Cart).Add"]  # the interface's isn't a symbol
    assert f"{M}/pkg/bottom.Base" in column(tools.find_symbol("B*e"), "qname")
    assert default.find_symbol("Println").rows == [] and default.find_symbol("Println", scope="all").rows == []
    assert column(tools.find_symbol("Println", scope="all"), "tier") == ["stdlib"] and tools.find_symbol("Println").rows == []
    assert column(tools.find_symbol("Tool"), "tier") == ["direct"] and tools.find_symbol("Tool", scope="workspace").rows == []
    assert tools.find_symbol("Label", kind="nonsense").rows == []
    for bad in (lambda: tools.find_symbol(" "), lambda: tools.find_symbol("x", scope="bogus")):
        with pytest.raises(model.QueryError):
            bad()
    assert '"qname": "example.com/shop.Label"' in tools.find_symbol("Label").json()
    assert tools.find_symbol("Label").text.splitlines() == ["1 hit(s)", f"main.go:17  [workspace func]  {M}.Label"]


def test_definition(tools):
    at = tools.definition("main.go", 12, 14).rows[0]
    assert (at["qname"], at["kind"], at["file"], at["line"], at["col"]) == (M + ".Label", "func", "main.go", 17, 6)
    local = tools.definition("main.go", 11, 2).rows[0]
    assert (local["file"], local["line"], local["col"]) == ("main.go", 10, 2)
    assert tools.definition("main.go", 11, 4).rows[0]["qname"] == f"(*{M}.Cart).Add"
    assert tools.definition("extra.go", 48, 8).rows[0]["line"] == 11  # a field of a generic struct
    with pytest.raises(model.QueryError):
        tools.definition("main.go", 1000, 1)
    with pytest.raises(model.QueryError):
        tools.definition("main.go", 0)


def test_references(tools, default):
    assert [(r["file"], r["line"]) for r in tools.references(M + ".Label").rows] == [("extra.go", 44), ("main.go", 12)]
    base = tools.references(M + "/pkg/bottom.Base")
    assert [(r["file"], r["line"]) for r in base.rows] == [("main.go", 13), ("main.go", 25), ("pkg/bottom/bottom_test.go", 6)]
    some = tools.references(M + "/pkg/bottom.Base", limit=2)
    assert len(some.rows) == 2 and some.extra["truncated"] and "truncated" in some.text
    assert tools.references(M + "/pkg/bottom.Base", limit=3).extra["truncated"]  # the limit was met
    assert not base.extra["truncated"]
    # Calls through the interface are uses of the interface's method only.
    assert [(r["file"], r["line"]) for r in tools.references(f"(*{M}.Cart).Add").rows] == [("main.go", 11)]
    assert len(tools.references("fmt.Println").rows) == 2 and len(tools.references("fmt.Fprintln", scope="all").rows) == 1
    assert tools.references("fmt.Fprintln").rows == [] and default.references("fmt.Println", scope="all").rows == []
    assert tools.references(M + ".Label", package_glob=M + "/pkg/...").rows == [] and tools.references("no.such").rows == []


def test_implementations(tools):
    got = column(tools.implementations(M + ".Buyer"), "qname")
    assert got == [M + ".Big", M + ".Cart"]
    assert tools.implementations(M + ".Cart").rows == [] and tools.implementations("no.such").rows == []
    assert column(tools.ast_grep("implements", iface=M + ".Buyer", package_glob=M), "qname") == [M + ".Big", M + ".Cart"]
    assert tools.ast_grep("implements", iface="no.such").rows == []
    with pytest.raises(model.QueryError):
        tools.ast_grep("implements", iface=M + ".Cart")


def test_ast_grep(tools):
    assert [(r["line"], r["col"]) for r in tools.ast_grep("call", func="fmt.Println").rows] == [(12, 2), (13, 2)]
    assert tools.ast_grep("call", func="fmt.Println", n_args=2).rows == []
    assert [r["qname"] for r in tools.ast_grep("call", func=f"(*{M}.Cart).*").rows] == [f"(*{M}.Cart).Pay", f"(*{M}.Cart).Pay", f"(*{M}.Cart).Add", f"(*{M}.Cart).Pay"]
    assert [(r["file"], r["line"]) for r in tools.ast_grep("conv", target=M + ".Number").rows] == [("extra.go", 39)]
    assert [(r["file"], r["line"]) for r in tools.ast_grep("typeassert", target="*" + M + ".Cart").rows] == [("extra.go", 27)]
    assert tools.ast_grep("typeassert", target=M + ".Cart").rows == [] and tools.ast_grep("typeassert", target="*" + M + ".Big").rows == []
    for bad in (lambda: tools.ast_grep("call"), lambda: tools.ast_grep("conv"), lambda: tools.ast_grep("what"), lambda: tools.ast_grep("implements")):
        with pytest.raises(model.QueryError):
            bad()


def test_calls(tools):
    assert set(column(tools.callees(M + ".main"), "callee_qname")) == {f"(*{M}.Cart).Add", M + ".Label", "fmt.Println", M + "/pkg/bottom.Base"}
    assert set(column(tools.callers(M + "/pkg/bottom.Base"), "caller_qname")) == {M + ".main", f"(*{M}.Cart).Pay", M + "/pkg/bottom.TestBase"}
    assert column(tools.callees(f"(*{M}.Cart).Add"), "callee_qname") == [f"(*{M}.Cart).Pay"]
    served = set(column(tools.callees(M + ".serve"), "callee_qname"))
    assert {f"(*{M}.Cart).Add", f"(*{M}.Cart).Pay", f"({M}.Big).Name", M + ".show", "example.com/dep/kit.Tool", M + ".Make"} <= served  # interface and function values, too
    assert M + ".Label" in column(tools.callees(M + ".serve$1"), "callee_qname")
    for bad in (lambda: tools.callers(M + ".main", "fast"), lambda: tools.callees("no.such"), lambda: tools.callees(M + ".main", "rta"), lambda: tools.callees(M + ".main", "rta", ["no.such"])):
        with pytest.raises(model.QueryError):
            bad()


def test_rta_keeps_to_what_the_entries_reach(tools):
    assert {f"(*{M}.Cart).Add", M + ".Label"} <= set(column(tools.callees(M + ".main", "RTA", [M + ".main", "no.such"]), "callee_qname"))
    assert column(tools.callers(M + ".Label", "rta", [M + ".main"]), "caller_qname") == [M + ".main"]
    assert tools.callees(M + ".serve", "rta", [M + ".main"]).rows == []
    assert f"(*{M}.Cart).Add" in column(tools.callees(M + ".serve", "rta", [M + ".wired"]), "callee_qname")


def test_reverse_trace(tools):
    got = tools.reverse_trace(M + "/pkg/bottom.Base", [M + ".main"])
    assert got.extra["found"] and got.rows[0]["caller_qname"] == M + ".main" and got.rows[-1]["callee_qname"] == M + "/pkg/bottom.Base"
    far = tools.reverse_trace(M + "/pkg/bottom.Base", [M + ".Label", M + ".wired"])
    assert [r["callee_qname"] for r in far.rows][0] == M + ".serve" and len(far.rows) == 3
    none = tools.reverse_trace(M + "/pkg/bottom.Base", [M + ".Label"])
    assert none.rows == [] and not none.extra["found"]
    with pytest.raises(model.QueryError):
        tools.reverse_trace(M + ".main", [])


def test_cite_resolve(tools, spark):
    got = tools.cite_resolve("lib/text.rs:4").rows[0]
    assert (got["file"], got["line"], got["line_text"], got["context_line"]) == ("third/lib/text.rs", 4, "the telling line", 4)
    wide = tools.cite_resolve("upstream/lib/text.rs:4", 1).rows[0]  # the second pattern and layout
    assert wide["context"] == "three\nthe telling line\nfive" and wide["context_line"] == 3 and wide["pattern"] == r"\.rs:"
    assert tools.cite_resolve("lib/text.rs:1", 9).rows[0]["context"].count("\n") == 4
    for bad in ("lib/text.rs", "lib/text.rs:99", "lib/text.rs:0", "lib/../../x.rs:1", "other.txt:1", "lib/none.rs:1", ""):
        with pytest.raises(model.QueryError):
            tools.cite_resolve(bad)


def test_proto_field_xref(tools):
    for name in ("order_id", "OrderId"):
        got = tools.proto_field_xref("Update", name)
        assert got.extra["field"]["field_qname"] == M + "/pkg/wire.Update.OrderId" and got.extra["field"]["proto_field"] == "order_id"
        assert [(r["file"], r["line"]) for r in got.rows] == [("extra.go", 40), ("extra.go", 41), ("pkg/wire/read.go", 4)]
    assert tools.proto_field_xref("Update", "body").rows == []
    for name in ("hidden", "Plain", "none"):
        assert tools.proto_field_xref("Update", name).extra["field"] is None
    assert tools.proto_field_xref("Update", "order_id", limit=1).extra["truncated"]


def test_lint(spark, tools):
    assert tools.lint().text == "no analyzers configured"
    facts = source_facts(spark, [Root(GUARDED, "example.com/guarded", main=True), Root(STD)])
    banned = {"banned": ["time.Now", "os.*"], "scope": ["example.com/guarded/inside"]}
    own = Tools(spark, facts, C.parse({"lint": [{"import": "bannedinscope", "config": banned}]}), GUARDED)
    got = own.lint()
    assert [(r["file"], r["line"], r["severity"]) for r in got.rows] == [("inside/a.go", 8, "error"), ("inside/a.go", 10, "error")]
    assert got.rows[0]["message"] == "call to banned time.Now in scope example.com/guarded/inside"
    assert own.lint(analyzers=["other"]).rows == [] and own.lint(package_glob="example.com/guarded/outside").rows == []
    for wrong in ({}, {"banned": "x"}, {"banned": [1]}, {"banned": ["x"], "scope": [2]}):
        with pytest.raises(model.QueryError):
            lint.build([("bannedinscope", wrong)])
    with pytest.raises(model.QueryError):
        lint.build([("unknown", {})])


def test_analyzers_can_be_added(spark, facts):
    @lint.register("test/flag-label")
    def factory(config):
        if config.get("off"):
            return None
        from pyspark.sql import functions as F

        return lint.Analyzer("flaglabel", lambda f: f["symbols"].where("sname = 'Label'").select("pkg_path", "file", "line", "col", F.lit("found").alias("message"), F.lit("").alias("category")))

    try:
        assert lint.keys() == ["bannedinscope", "test/flag-label"]
        with pytest.raises(ValueError):
            lint.register("test/flag-label", factory)
        assert lint.run(facts, lint.build([("test/flag-label", {})])).count() == 1
        assert lint.build([("test/flag-label", {"off": True})]) == []
    finally:
        lint.unregister("test/flag-label")


def test_resources_modules_docs_and_commands(spark, tools, facts):
    assert column(tools.resources(), "uri") == ["repo:notes/README.md", "repo:../secret"]
    got = tools.read_resource("repo:notes/README.md").rows[0]
    assert got["mime"] == "text/markdown" and "shop fixture" in got["text"]
    for bad in ("repo:../secret", "repo:main.go"):
        with pytest.raises(model.QueryError):
            tools.read_resource(bad)
    assert module_of(spark, SHOP) == M and module_of(spark, STD) == ""
    assert '"Path":"example.com/dep"' in tools.go_list_modules().text
    docs = Tools(spark, dict(facts) | {"docs": spark.createDataFrame([("fmt.Println", "x" * 40_000)], model.SCHEMAS["docs"])})
    assert len(docs.go_doc("fmt.Println").text) < 17_000 and "clipped" in docs.go_doc("fmt.Println").text
    assert docs.run_test(["no-such-program"]).extra["exit_code"] == -1
    ran = docs.run_test(["sh", "-c", "echo out; exit 3"])
    assert ran.extra == {"exit_code": 3, "truncated": False} and ran.text == "out\n"
    assert "workspace" in docs.tier_breakdown().text


def test_snapshots(spark, facts, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/snaps")
    assert store.current() is None
    first = store.publish({k: facts[k] for k in ("symbols", "ast_nodes")})
    second = store.publish({k: facts[k].limit(1) for k in ("symbols", "ast_nodes")})
    assert store.current() == second and store.open()["symbols"].count() == 1
    assert store.open(first)["symbols"].count() == facts["symbols"].count()
    plan = store.open(first)["symbols"].where("tier_rank = 4")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tier_rank" in plan


def test_reload_keeps_the_old_snapshot_when_it_fails(spark, facts, tmp_path):
    from quarry.streaming.reload import republish

    store = Snapshots(spark, f"file://{tmp_path}/snaps")
    republish(lambda: {"symbols": facts["symbols"].limit(2)}, store.publish)(None, 0)
    first = store.current()

    def broken():
        raise RuntimeError("no load")

    republish(broken, store.publish)(None, 1)
    assert store.current() == first and store.open()["symbols"].count() == 2


def test_root(tmp_path):
    assert C.resolve_root(SHOP) == SHOP == C.resolve_root("", {"QUARRY_ROOT": SHOP}) == C.resolve_root("", {}, SHOP)
    with pytest.raises(model.QueryError):
        C.resolve_root(str(tmp_path))


def test_config(tmp_path):
    assert C.load(str(tmp_path / "none.yaml")) == C.Config()
    (tmp_path / "c.yaml").write_text("dep_index: {direct: false, stdlib: true}\nentry_points: {cli: [a.main]}\n")
    got = C.load(str(tmp_path / "c.yaml"))
    assert got.version == 1 and got.tiers == (model.WORKSPACE, model.STDLIB) and got.entry_points == {"cli": ["a.main"]}
    assert C.with_preset(got, "all").tiers == (4, 3, 2, 1) and C.with_preset(got, "workspace").tiers == (4,) and C.with_preset(got, "") == got
    with pytest.raises(model.QueryError):
        C.with_preset(got, "bogus")
    assert citations.Pattern("x", "y").description == ""


def test_lint_configuration_names_its_keys(tools):
    banned = {"banned": ["time.Now"], "scope_packages": ["example.com/guarded/inside"]}
    assert lint.build([("bannedinscope", banned)])[0].name == "bannedinscope"
    with pytest.raises(model.QueryError):
        lint.build([("bannedinscope", {"banned": ["time.Now"], "scopes": ["x"]})])


def test_test_command(tools):
    assert tools.test_command() == ["go", "test", "./..."]
    assert tools.test_command(["./pkg"], "TestX", ["a", "b"], True, 2, True) == ["go", "test", "-run", "TestX", "-tags", "a,b", "-race", "-count=2", "-v", "./pkg"]
    for bad in ({"packages": ["-exec=rm"]}, {"packages": [" "]}, {"count": 0}):
        with pytest.raises(model.QueryError):
            tools.test_command(**bad)


def test_functions_and_load_errors(tools):
    name = tools.facts["functions"].where("not synthetic").first().qname
    assert tools.functions(name).extra["count"] >= 1
    with pytest.raises(model.QueryError):
        tools.functions("no.Such")
    assert tools.load_faults().extra["count"] == tools.facts["faults"].count()
