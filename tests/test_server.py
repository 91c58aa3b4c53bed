"""The server on standard input and output, and the modules of a tree."""

import json
import shutil
from pathlib import Path

import pytest

from quarry.serve import BAD_PARAMS, NO_METHOD, NO_REQUEST, OFFERED, UNPARSED, Server
from quarry.sources import modules
from quarry.sources.source_tree import Root

HERE = Path(__file__).parent / "fixtures"
M = "example.com/shop"

GO_MOD = """// shop
module "example.com/shop"

go 1.22

require example.com/dep v1.2.0
require (
\texample.com/Far v0.1.0 // indirect
\texample.com/near v0.3.0 // needed by tests
\texample.com/moved v2.0.0 // indirect; see the notes
\texample.com/lost v1.0.0
)

replace example.com/near => ./near
replace (
\texample.com/moved v1.0.0 => /nowhere
\texample.com/moved v2.0.0 => example.com/dep v1.2.0
)
exclude example.com/dep v1.1.0
"""


def test_requirements_of_a_go_mod():
    got = modules.parse(GO_MOD)
    assert got.path == M
    assert [(r.path, r.version, r.indirect) for r in got.requirements] == [
        ("example.com/dep", "v1.2.0", False),
        ("example.com/Far", "v0.1.0", True),
        ("example.com/near", "v0.3.0", False),
        ("example.com/moved", "v2.0.0", True),
        ("example.com/lost", "v1.0.0", False),
    ]
    assert modules.parse("") == modules.Module("")
    assert modules.escaped("example.com/BigName") == "example.com/!big!name"


def test_roots_follow_replacements_vendor_and_cache(spark, tmp_path):
    shop, cache = tmp_path / "shop", tmp_path / "cache"
    for folder in (shop / "near", cache / "example.com" / "dep@v1.2.0", cache / "example.com" / "!far@v0.1.0"):
        folder.mkdir(parents=True)
    (shop / "go.mod").write_text(GO_MOD)
    roots, missing = modules.roots(spark, str(shop), str(cache), "/std")
    dep = f"{cache}/example.com/dep@v1.2.0"
    assert roots == [
        Root(str(shop), M, main=True),
        Root(dep, "example.com/dep"),
        Root(f"{shop}/./near", "example.com/near"),
        Root(f"{cache}/example.com/!far@v0.1.0", "example.com/Far", indirect=True),
        Root(dep, "example.com/moved", indirect=True),
        Root("/std"),
    ]
    assert [r.path for r in missing] == ["example.com/lost"]
    (shop / "vendor" / "example.com" / "dep").mkdir(parents=True)
    assert modules.roots(spark, str(shop), str(cache))[0][1].folder == f"{shop}/vendor/example.com/dep"
    assert modules.roots(spark, str(tmp_path / "cache"))[0] == [Root(str(cache), "", main=True)]


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    from quarry.__main__ import arguments, load

    root = tmp_path_factory.mktemp("served") / "shop"
    shutil.copytree(HERE / "shop", root)
    (root / "go.mod").write_text(f"module {M}\n\nrequire example.com/dep v1.0.0\n\nreplace example.com/dep => {HERE / 'dep'}\n")
    tools = load(spark, arguments(["--root", str(root), "--std", str(HERE / "std"), "--deps", "direct"]))
    return Server(lambda: tools)


def ask(server, method, **params):
    return json.loads(server.answer(json.dumps({"jsonrpc": "2.0", "id": 7, "method": method, "params": params})))


def test_a_session(server):
    assert ask(server, "initialize")["result"]["capabilities"] == {"tools": {}, "resources": {}}
    listed = {t["name"]: t["inputSchema"] for t in ask(server, "tools/list")["result"]["tools"]}
    assert list(listed) == list(OFFERED)
    assert listed["reverse_trace"]["required"] == ["target", "entry_points"]
    assert listed["reverse_trace"]["properties"]["entry_points"] == {"type": "array", "items": {"type": "string"}}
    assert "command" not in listed["run_test"]["properties"]
    got = ask(server, "tools/call", name="find_symbol", arguments={"name": "Label"})["result"]
    assert not got["isError"] and [r["qname"] for r in got["structuredContent"]["rows"]] == [M + ".Label"]
    assert {r["tier"] for r in ask(server, "tools/call", name="tier_breakdown", arguments={})["result"]["structuredContent"]["rows"]} == {"workspace", "direct"}


def test_refusals_are_results_and_faults_are_errors(server):
    def refused(tool, /, **given):
        got = ask(server, "tools/call", name=tool, arguments=given)["result"]
        return got["isError"] and got["content"][0]["text"]

    assert refused("find_symbol", name=" ") == "name is required"
    for given in ({}, {"name": 3}, {"name": "x", "other": 1}):
        assert "is unknown, missing or of another type" in refused("find_symbol", **given)
    assert "positive" not in refused("definition", file="x.go", line=True)
    assert refused("run_test", packages=["-exec=x"]) == "packages must be package patterns"
    assert ask(server, "tools/call", name="_rows")["error"]["code"] == BAD_PARAMS
    assert ask(server, "resources/read", uri="repo:../x")["error"]["code"] == BAD_PARAMS
    assert ask(server, "nothing")["error"]["code"] == NO_METHOD
    assert json.loads(server.answer("{"))["error"]["code"] == UNPARSED
    assert json.loads(server.answer("[]"))["error"]["code"] == NO_REQUEST
    assert list(server.run(["\n", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})])) == []
