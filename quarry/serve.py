"""The tools as a server on standard input and output: JSON-RPC 2.0, one message a line.

Methods: initialize, ping, tools/list, tools/call, resources/list, resources/read.  A tool that refuses
its arguments answers with ``isError``; messages that are no requests of this protocol get an error
of the protocol; notifications get no answer.
"""

from __future__ import annotations

import inspect
import json
import types
import typing
from collections.abc import Callable, Iterable, Iterator

from . import model
from .tools import Result, Tools

#: Fixed values of the protocol: its version and the codes of its errors.
PROTOCOL = "2024-11-05"
UNPARSED, NO_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603

#: Methods of ``Tools`` that are offered.
OFFERED = (
    "find_symbol", "definition", "references", "implementations", "ast_grep", "callers", "callees", "reverse_trace",
    "cite_resolve", "proto_field_xref", "lint", "go_doc", "go_list_modules", "run_test", "load_faults", "functions", "tier_breakdown",
)


class Fault(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


_TYPES = {str: "string", int: "integer", bool: "boolean", float: "number"}


def _shape(hint) -> dict:
    """JSON schema of an argument's type."""
    if typing.get_origin(hint) is list:
        return {"type": "array", "items": _shape(typing.get_args(hint)[0])}
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        return _shape(next(a for a in typing.get_args(hint) if a is not type(None)))
    return {"type": _TYPES[hint]}


def schema(method: Callable) -> dict:
    """JSON schema of a tool's arguments, from its signature."""
    hints = typing.get_type_hints(method)
    own = [p for n, p in inspect.signature(method).parameters.items() if n != "self"]
    return {
        "type": "object",
        "properties": {p.name: _shape(hints[p.name]) for p in own},
        "required": [p.name for p in own if p.default is p.empty],
        "additionalProperties": False,
    }


def _fits(value, shape: dict) -> bool:
    kind = shape["type"]
    if kind == "array":
        return isinstance(value, list) and all(_fits(v, shape["items"]) for v in value)
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, {"string": str, "integer": int, "number": (int, float), "boolean": bool}[kind])


class Server:
    """Answers messages with the tools that ``current`` gives; it is asked anew for each call, so a reload takes effect."""

    def __init__(self, current: Callable[[], Tools], name: str = "quarry", version: str = "1"):
        self.current, self.name, self.version = current, name, version
        # A test run is asked for by what makes up its command, never by a command.
        self.schemas = {t: schema(getattr(Tools, "test_command" if t == "run_test" else t)) for t in OFFERED}

    def _initialize(self, params: dict) -> dict:
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": self.name, "version": self.version}}

    def _list_tools(self, params: dict) -> dict:
        about = {t: inspect.getdoc(getattr(Tools, t)) or t.replace("_", " ") for t in OFFERED}
        return {"tools": [{"name": t, "description": about[t], "inputSchema": self.schemas[t]} for t in OFFERED]}

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in self.schemas:
            raise Fault(BAD_PARAMS, f"unknown tool {name!r}")
        if not isinstance(given, dict):
            raise Fault(BAD_PARAMS, "arguments must be an object")
        shape = self.schemas[name]
        wrong = [k for k in given if k not in shape["properties"]]
        wrong += [k for k in shape["required"] if k not in given]
        wrong += [k for k, v in given.items() if k in shape["properties"] and v is not None and not _fits(v, shape["properties"][k])]
        if wrong:
            return {"content": [{"type": "text", "text": f"{name}: argument {wrong[0]!r} is unknown, missing or of another type"}], "isError": True}
        try:
            got: Result = getattr(self.current(), name)(**{k: v for k, v in given.items() if v is not None})
        except model.QueryError as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": got.text}], "structuredContent": json.loads(got.json()), "isError": False}

    def _list_resources(self, params: dict) -> dict:
        rows = self.current().resources().rows
        return {"resources": [{"uri": r["uri"], "name": r["title"] or r["uri"], "description": r["description"]} for r in rows]}

    def _read(self, params: dict) -> dict:
        try:
            got = self.current().read_resource(str(params.get("uri", "")))
        except model.QueryError as e:
            raise Fault(BAD_PARAMS, str(e)) from e
        return {"contents": [{"uri": params["uri"], "mimeType": got.rows[0].get("mime") or "text/plain", "text": got.text}]}

    def _result(self, method: str, params: dict) -> dict:
        known = {
            "initialize": self._initialize,
            "ping": lambda p: {},
            "tools/list": self._list_tools,
            "tools/call": self._call,
            "resources/list": self._list_resources,
            "resources/read": self._read,
        }
        if method not in known:
            raise Fault(NO_METHOD, f"unknown method {method!r}")
        return known[method](params)

    def answer(self, line: str) -> str | None:
        """The answer to one line, or None for a notification."""
        key = None
        try:
            try:
                message = json.loads(line)
            except ValueError as e:
                raise Fault(UNPARSED, "not JSON") from e
            if not isinstance(message, dict) or not isinstance(message.get("method"), str):
                raise Fault(NO_REQUEST, "not a request")
            if "id" not in message:
                return None
            key = message["id"]
            params = message.get("params") or {}
            if not isinstance(params, dict):
                raise Fault(BAD_PARAMS, "params must be an object")
            body = {"result": self._result(message["method"], params)}
        except Fault as e:
            body = {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:  # a query that fails must not end the server
            body = {"error": {"code": INTERNAL, "message": f"{type(e).__name__}: {e}"}}
        return json.dumps({"jsonrpc": "2.0", "id": key, **body}, ensure_ascii=False)

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip():
                out = self.answer(line)
                if out is not None:
                    yield out
