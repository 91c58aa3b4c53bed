"""What other packages need to know of a file: its package-level declarations, as plain data.

Types are nested lists: ["named", qname, args], ["ptr", t], ["slice", t], ["array", t], ["map", k, v],
["chan", t], ["func", params, results, variadic], ["struct", fields], ["iface", methods, embedded],
["basic", name], ["param", name], ["tuple", types]; None is unknown.
"""

from __future__ import annotations

from .parser import Node

#: Predeclared types and functions.
BASIC = frozenset("bool string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 byte rune error any comparable".split())
BUILTINS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover".split())


class Scope:
    """How names in type position resolve: type parameters, imports, else the package itself."""

    def __init__(self, pkg: str, imports: dict[str, str], params: frozenset[str] = frozenset(), local: dict | None = None):
        self.pkg, self.imports, self.params, self.local = pkg, imports, params, local or {}

    def with_params(self, names) -> Scope:
        return Scope(self.pkg, self.imports, self.params | frozenset(names), self.local)

    def type(self, n: Node | None):
        if n is None:
            return None
        k = n.kind
        if k == "Ident":
            if n.name in self.local:
                return self.local[n.name]
            if n.name in self.params:
                return ["param", n.name]
            return ["basic", n.name] if n.name in BASIC else ["named", f"{self.pkg}.{n.name}", []]
        if k == "Selector" and n.x.kind == "Ident":
            path = self.imports.get(n.x.name)
            return ["named", f"{path}.{n.sel.name}", []] if path else None
        if k == "Index":
            base = self.type(n.x)
            return ["named", base[1], [self.type(a) for a in n.args]] if base and base[0] == "named" else None
        if k in ("Star", "Paren"):
            inner = self.type(n.x)
            return ["ptr", inner] if k == "Star" else inner
        if k in ("SliceType", "ArrayType", "ChanType"):
            return [k[:-4].lower(), self.type(n.elem)]
        if k == "MapType":
            return ["map", self.type(n.key), self.type(n.elem)]
        if k == "FuncType":
            return ["func", [self.type(p.type) for p in n.params], [self.type(p.type) for p in n.results], bool(n.params and n.params[-1].variadic)]
        if k == "StructType":
            return ["struct", [f for field in n.fields for f in self.fields(field)]]
        if k == "InterfaceType":
            return ["iface", [[m.name.name, self.type(m.sig)] for m in n.methods], [self.type(e) for e in n.embedded if e.kind != "UnionType"]]
        return None

    def fields(self, field: Node) -> list:
        """[name, type, embedded, line, col] of a struct's field list entry."""
        t = self.type(field.type)
        if field.names:
            return [[i.name, t, False, i.line, i.col] for i in field.names]
        base = t[1] if t and t[0] == "ptr" else t
        name = base[1].rsplit(".", 1)[-1] if base and base[0] in ("named", "basic") else "?"
        return [[name, t, True, field.line, field.col]]


def imports_of(file: Node) -> dict[str, str]:
    """Local name -> path; a path's last part (past a version) stands for an unnamed import."""
    out = {}
    for i in file.imports:
        if i.alias in ("_", "."):
            continue
        parts = i.path.split("/")
        last = parts[-2] if len(parts) > 1 and parts[-1][:1] == "v" and parts[-1][1:].isdigit() else parts[-1]
        out[i.alias or last.split(".")[0].replace("go-", "")] = i.path
    return out


def literal_type(n: Node | None, scope: Scope):
    """Type of an initialiser, as far as its shape tells."""
    if n is None:
        return None
    if n.kind == "Literal":
        return ["basic", {"string": "string", "char": "rune"}.get(n.what, "float64" if "." in n.text else "int")]
    if n.kind == "Composite":
        return scope.type(n.type)
    if n.kind == "Unary" and n.op == "&" and n.x.kind == "Composite":
        return ["ptr", scope.type(n.x.type)]
    if n.kind == "FuncLit":
        return scope.type(n.sig)
    return None


def summarise(file: Node, pkg: str) -> dict:
    """Declarations by name: funcs, methods, types, vars, consts."""
    scope = Scope(pkg, imports_of(file))
    out: dict = {"funcs": {}, "methods": [], "types": {}, "vars": {}, "consts": {}}
    for d in file.decls:
        if d.kind == "Func":
            own = scope.with_params(p.name.name for p in d.params)
            if d.receiver is None:
                out["funcs"][d.name.name] = [own.type(d.sig), d.name.line, d.name.col]
            else:
                t, pointer, names = receiver(d.receiver)
                sig = own.with_params(names).type(d.sig)
                out["methods"].append([t, pointer, d.name.name, sig, d.name.line, d.name.col])
        elif d.kind == "Type":
            own = scope.with_params(p.name.name for p in d.params)
            out["types"][d.name.name] = [own.type(d.type), d.alias, d.name.line, d.name.col, [p.name.name for p in d.params]]
        else:
            for k, name in enumerate(d.names):
                value = d.values[k] if len(d.values) == len(d.names) else None
                t = scope.type(d.type) or literal_type(value, scope)
                out["vars" if d.kind == "Var" else "consts"][name.name] = [t, name.line, name.col]
    return out


def receiver(param: Node) -> tuple[str, bool, list[str]]:
    """Type name, whether it is a pointer, names of its type parameters."""
    t, pointer = param.type, False
    while t.kind in ("Star", "Paren"):
        pointer = pointer or t.kind == "Star"
        t = t.x
    return (t.x.name, pointer, [a.name for a in t.args if a.kind == "Ident"]) if t.kind == "Index" else (t.name, pointer, [])
