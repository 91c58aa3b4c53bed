"""The query surface: fourteen tools over a set of facts, validated, with text and structured results.

A tool returns a ``Result``: rows as dictionaries, extra fields, and the text a reader would see.
Arguments that a tool refuses raise ``QueryError``.
"""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import names
from .functions import text as T
from .operators import callgraph, citations, implements, lint, proto, references, resources, syntax
from .operators import symbols as S
from .sources.config import Config


@dataclass
class Result:
    rows: list[dict] = field(default_factory=list)
    text: str = ""
    extra: dict[str, Any] = field(default_factory=dict)

    def json(self) -> str:
        """The structured result as one JSON object."""
        return json.dumps({"rows": self.rows, **self.extra}, default=str, ensure_ascii=False)


def required(**values: str) -> None:
    for name, value in values.items():
        if not (value or "").strip():
            raise model.QueryError(f"{name} is required")


def _rows(df: DataFrame, order: list[str]) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def _symbol_text(rows: list[dict]) -> str:
    return "\n".join([f"{len(rows)} hit(s)", *(f"{r['file']}:{r['line']}  [{r['tier']} {r['kind']}]  {r['qname']}" for r in rows)])


def _place_text(rows: list[dict], truncated: bool = False) -> str:
    lines = [f"{len(rows)} reference(s)", *(f"{r['file']}:{r['line']}:{r['col']}" for r in rows)]
    return "\n".join(lines + ["(truncated; narrow the query or raise limit)"] * truncated)


class Tools:
    """Tools over one snapshot's facts.  Call graphs are built on first use."""

    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame], config: Config | None = None, root: str = ""):
        self.spark, self.facts, self.config, self.root = spark, facts, config or Config(), root
        self._cha: DataFrame | None = None

    def _relative(self, rows: list[dict]) -> list[dict]:
        base = self.root.rstrip("/") + "/"
        return [r | {"file": r["file"].removeprefix(base)} for r in rows] if self.root else rows

    def _absolute(self, file: str) -> str:
        return file if file.startswith("/") or not self.root else f"{self.root.rstrip('/')}/{file}"

    # Symbols and references

    def find_symbol(self, name: str, kind: str | None = None, scope: str | None = None) -> Result:
        required(name=name)
        rows = self._relative(_rows(S.find(self.facts["symbols"], name.strip(), kind, scope), ["file", "line", "qname"]))
        return Result(rows, _symbol_text(rows))

    def definition(self, file: str, line: int, col: int = 1) -> Result:
        required(file=file)
        if line < 1:
            raise model.QueryError("line must be at least 1")
        point = self.spark.createDataFrame([(self._absolute(file), line, max(col, 1))], "file string, line int, col int")
        got = references.definition_at(self.facts["idents"], self.facts["symbols"], point).first()
        if got is None:
            raise model.QueryError(f"no identifier at {file}:{line}:{col}")
        row = self._relative([{k: got[k] for k in ("qname", "kind", "file", "line", "col")}])[0]
        return Result([row], f"{row['qname']}  [{row['kind']}]  {row['file']}:{row['line']}:{row['col']}")

    def references(self, qname: str, package_glob: str = "", scope: str | None = None, limit: int = 0) -> Result:
        required(qname=qname)
        found = references.references(self.facts["uses"], self.facts["symbols"], qname.strip(), package_glob, scope)
        rows = _rows(references.limited(found, limit, ["file", "line", "col"]), ["file", "line", "col"])
        truncated = bool(rows and rows[0]["truncated"])
        rows = self._relative([{k: r[k] for k in ("file", "line", "col")} for r in rows])
        return Result(rows, _place_text(rows, truncated), {"truncated": truncated})

    def implementations(self, iface: str, package_glob: str = "", scope: str | None = None) -> Result:
        required(iface=iface)
        rows = self._relative(_rows(implements.implementations(self.facts, names.strip_instantiation_text(iface.strip()), package_glob, scope), ["file", "line", "qname"]))
        return Result(rows, _symbol_text(rows))

    # Structure

    def ast_grep(self, kind: str, func: str = "", n_args: int | None = None, target: str = "", iface: str = "", package_glob: str = "", scope: str | None = None) -> Result:
        nodes = self.facts["ast_nodes"]
        if kind == "call":
            required(func=func)
            found = syntax.calls(nodes, func, n_args, package_glob, scope)
        elif kind in ("typeassert", "conv"):
            required(target=target)
            found = (syntax.type_assertions if kind == "typeassert" else syntax.conversions)(nodes, target, package_glob, scope)
        elif kind == "implements":
            required(iface=iface)
            qname = names.strip_instantiation_text(iface)
            known = S.by_qname(self.facts["symbols"], qname)
            if not known.isEmpty() and self.facts["named_types"].where((F.col("qname") == qname) & F.col("is_interface")).isEmpty():
                raise model.QueryError(f"{iface!r} is not an interface type")
            found = implements.implementing_types(self.facts, qname, package_glob, scope, loaded=True)
        else:
            raise model.QueryError(f"unknown kind {kind!r}: use call, typeassert, conv or implements")
        rows = self._relative(_rows(found, ["file", "line", "col"]))
        return Result(rows, "\n".join([f"{len(rows)} hit(s)", *(f"{r['file']}:{r['line']}:{r['col']}  {r['qname']}" for r in rows)]))

    # Call graph

    def _precision(self, precision: str) -> str:
        p = (precision or "").strip().lower() or "cha"
        if p not in ("cha", "rta"):
            raise model.QueryError(f"unknown precision {precision!r}: use cha or rta")
        return p

    def _function(self, qname: str) -> str:
        q = names.strip_instantiation_text(qname.strip())
        if self.facts["functions"].where((F.col("qname") == q) & ~F.col("synthetic")).isEmpty():
            raise model.QueryError(f"function not found: {qname}")
        return q

    def _edges(self, precision: str, entry_points: list[str]) -> DataFrame:
        from .plans.storage import keep

        if self._precision(precision) == "cha":
            if self._cha is None:
                self._cha = keep(callgraph.cha(self.facts), "cha")
            return self._cha
        if not entry_points:
            raise model.QueryError("rta: at least one entry point is required")
        asked = self.spark.createDataFrame([(names.strip_instantiation_text(e),) for e in entry_points], "node string")
        roots = asked.join(self.facts["functions"].select(F.col("qname").alias("node")).distinct(), "node", "left_semi")
        if roots.isEmpty():
            raise model.QueryError(f"rta: no entry points resolved (missing: {', '.join(entry_points)})")
        return callgraph.rta(self.facts, roots)[0]

    def _edge_result(self, df: DataFrame) -> Result:
        rows = self._relative(_rows(df, list(callgraph.ORDER)))
        out = [{"caller_qname": r["caller"], "callee_qname": r["callee"], "file": r["file"], "line": r["line"], "col": r["col"]} for r in rows]
        return Result(out, "\n".join([f"{len(out)} edge(s)", *(f"{r['caller_qname']} -> {r['callee_qname']}  {r['file']}:{r['line']}:{r['col']}" for r in out)]))

    def callers(self, qname: str, precision: str = "", entry_points: list[str] = ()) -> Result:
        required(qname=qname)
        self._precision(precision)
        q = self._function(qname)
        return self._edge_result(callgraph.callers(self._edges(precision, list(entry_points)), q))

    def callees(self, qname: str, precision: str = "", entry_points: list[str] = ()) -> Result:
        required(qname=qname)
        self._precision(precision)
        q = self._function(qname)
        return self._edge_result(callgraph.callees(self._edges(precision, list(entry_points)), q))

    def reverse_trace(self, target: str, entry_points: list[str], precision: str = "") -> Result:
        required(target=target)
        if not entry_points:
            raise model.QueryError("entry_points is required")
        self._precision(precision)
        edges = self._edges(precision, list(entry_points))
        path = callgraph.trace(edges, self._function(target), [names.strip_instantiation_text(e) for e in entry_points])
        rows = self._relative(path)
        out = [{"caller_qname": r["caller"], "callee_qname": r["callee"], "file": r["file"], "line": r["line"], "col": r["col"]} for r in rows]
        return Result(out, "\n".join(f"{r['caller_qname']} -> {r['callee_qname']}" for r in out) or "no path", {"found": bool(out)})

    # Citations, tagged fields, lint

    def cite_resolve(self, citation: str, context_lines: int = 0) -> Result:
        required(citation=citation)
        citation = citation.strip()
        asked = self.spark.createDataFrame([(citation,)], "citation string")
        patterns = list(self.config.citations)
        if not patterns or asked.where(citations.matched(F.col("citation"), patterns).isNotNull()).isEmpty():
            raise model.QueryError(f"no citation pattern matches {citation!r}")
        if asked.where(T.cite_line(F.col("citation")).isNotNull()).isEmpty():
            raise model.QueryError(f"no line number in {citation!r}")
        got = citations.resolve(asked, self._texts(), patterns, max(context_lines, 0)).first()
        if got is None:
            raise model.QueryError(f"file not found or line out of range: {citation}")
        row = got.asDict()
        del row["citation"]
        return Result([row], f"{row['file']}:{row['line']}\n{row['context']}")

    def _texts(self) -> DataFrame:
        """The vendored texts below the root, by path from the root."""
        if "cited_texts" not in self.facts:
            parts = None
            for r in sorted({p.root for p in self.config.citations}):
                base = f"{self.root.rstrip('/')}/{r}"
                rows = self.spark.read.text(base, wholetext=True, recursiveFileLookup=True)
                path = F.concat(F.lit(r.rstrip("/") + "/"), F.expr(f"substring(regexp_replace(_metadata.file_path, '^file:/*', '/'), {len(base.rstrip('/')) + 2})"))
                rows = rows.select(path.alias("path"), F.regexp_replace("value", r"\n\z", "").alias("text"))
                parts = rows if parts is None else parts.unionByName(rows)
            self.facts["cited_texts"] = parts
        return self.facts["cited_texts"]

    def proto_field_xref(self, message: str, field: str, proto_glob: str = "", ref_glob: str = "", limit: int = 0) -> Result:
        required(message=message, field=field)
        if not proto_glob and self.config.proto_packages:
            proto_glob = self.config.proto_packages[0]  # only the first is the default
        own = self.facts["struct_fields"].where(F.col("tier_rank") == model.WORKSPACE)
        found = proto.field_of(proto.fields(own, proto_glob), message.strip(), field.strip())
        got = found.drop("obj_id", "load_order").first()
        if got is None:
            return Result([], f"no proto field {message}.{field}", {"field": None, "truncated": False})
        uses = proto.uses_of(found, self.facts["uses"], ref_glob)
        rows = _rows(references.limited(uses, limit, ["file", "line", "col"]), ["file", "line", "col"])
        truncated = bool(rows and rows[0]["truncated"])
        rows = self._relative([{k: r[k] for k in ("file", "line", "col")} for r in rows])
        return Result(rows, _place_text(rows, truncated), {"field": got.asDict(), "truncated": truncated})

    def lint(self, analyzers: list[str] = (), package_glob: str = "") -> Result:
        if not self.config.lint:
            return Result([], "no analyzers configured")
        own = dict(self.facts) | {"ast_nodes": self.facts["ast_nodes"].where(F.col("tier_rank") == model.WORKSPACE)}
        found = lint.run(own, lint.build(list(self.config.lint)), list(analyzers) or None, package_glob)
        rows = self._relative(_rows(found, ["file", "line", "col", "message"]))
        return Result(rows, "\n".join([f"{len(rows)} diagnostic(s)", *(f"{r['file']}:{r['line']}:{r['col']}: {r['message']}" for r in rows)]), {"count": len(rows)})

    # Documentation, modules, tests, resources

    def go_doc(self, path: str) -> Result:
        """Documentation from the ``docs`` facts (path, text), clipped."""
        required(path=path)
        if "docs" not in self.facts:
            raise model.QueryError("no documentation is loaded")
        got = resources.documentation(self.facts["docs"], path.strip()).first()
        if got is None:
            raise model.QueryError(f"no documentation of {path}")
        return Result([got.asDict()], got.text)

    def go_list_modules(self) -> Result:
        return Result([], resources.module_list(self.facts["packages"]).first().text)

    def load_faults(self, limit: int = 50) -> Result:
        """Files that don't parse, with what is wrong: how many there are, and the first of them."""
        faults = self.facts.get("faults")
        if faults is None:
            return Result([], "0 load error(s)", {"count": 0})
        count = faults.count()
        rows = self._relative([{"file": r.path, "fault": r.fault} for r in faults.orderBy("path").limit(limit).collect()])
        return Result(rows, "\n".join([f"{count} load error(s)", *(f"{r['file']}: {r['fault']}" for r in rows)]), {"count": count})

    def functions(self, qname: str) -> Result:
        """The functions of a qualified name, one for each variant."""
        required(qname=qname)
        own = self.facts["functions"].where(F.col("qname") == names.strip_instantiation_text(qname.strip()))
        got = callgraph.functions_by_qname(own).first()
        if got is None:
            raise model.QueryError(f"function not found: {qname}")
        return Result([{"qname": got.qname, "fn_id": f} for f in got.fn_ids], "\n".join(got.fn_ids), {"count": got.n})

    def test_command(self, packages: list[str] = (), run: str = "", tags: list[str] = (), race: bool = False, count: int | None = None, verbose: bool = False) -> list[str]:
        """The command that tests ``packages`` (all by default); a package that looks like a flag is refused."""
        if any(not p.strip() or p.startswith("-") for p in packages):
            raise model.QueryError("packages must be package patterns")
        if count is not None and count < 1:
            raise model.QueryError("count must be at least 1")
        flags = [*(["-run", run] if run else []), *(["-tags", ",".join(tags)] if tags else []), *["-race"] * race, *([f"-count={count}"] if count else []), *["-v"] * verbose]
        return ["go", "test", *flags, *(packages or ["./..."])]

    def run_test(self, command: list[str] | None = None, timeout: float = 300.0, **how) -> Result:
        """Run a test command (or that of ``test_command``) at the root; its output is clipped.  Exit code -1: it couldn't start."""
        command = self.test_command(**how) if command is None else command
        try:
            done = subprocess.run(command, cwd=self.root or None, capture_output=True, text=True, timeout=timeout, check=False)
            code, output = done.returncode, done.stdout + done.stderr
        except (OSError, subprocess.TimeoutExpired) as e:
            code, output = -1, str(e)
        clipped = self.spark.createDataFrame([(output,)], "t string").select(T.clip(F.col("t"), T.LIST_CAP).alias("t")).first().t
        return Result([], clipped, {"exit_code": code, "truncated": clipped != output})

    def resources(self) -> Result:
        rows = [{"uri": f"repo:{r.path}", "title": r.title, "description": r.description} for r in self.config.resources]
        return Result(rows, "\n".join(r["uri"] for r in rows))

    def read_resource(self, uri: str) -> Result:
        declared = self.spark.createDataFrame([(r.path,) for r in self.config.resources if f"repo:{r.path}" == uri], "path string")
        if declared.isEmpty() or declared.where(T.safe_path(F.col("path"))).isEmpty():
            raise model.QueryError(f"resource not found: {uri}")
        path = uri.removeprefix("repo:")
        files = self.spark.read.text(f"{self.root.rstrip('/')}/{path}", wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
        got = resources.read(files, declared).first()
        return Result([got.asDict()], got.text)

    def tier_breakdown(self) -> Result:
        rows = [r.asDict() for r in S.tier_breakdown(self.facts["symbols"]).collect()]
        return Result(rows, ", ".join(f"{r['tier']}: {r['n']}" for r in rows))
