"""Names and types of one package's files, given the summaries of all packages it reaches.

Emits fact rows.  What it can't resolve it marks as such (``resolved`` false, null callee) instead of
leaving it out.
"""

from __future__ import annotations

from collections.abc import Callable

from .parser import Node
from .summary import BASIC, BUILTINS, Scope, imports_of, literal_type, receiver

ERROR = ["iface", [["Error", ["func", [], [["basic", "string"]], False]]], []]


def text(t) -> str:
    """Canonical text of a type: equal types have equal texts."""
    if t is None:
        return "?"
    k = t[0]
    if k == "basic":
        return {"byte": "uint8", "rune": "int32"}.get(t[1], t[1])
    if k == "named":
        return t[1] + (f"[{','.join(map(text, t[2]))}]" if t[2] else "")
    if k == "func":
        rest = "..." if t[3] else ""
        results = ",".join(map(text, t[2]))
        return f"func({','.join(map(text, t[1]))}{rest})" + (f" ({results})" if len(t[2]) > 1 else f" {results}" if results else "")
    if k == "struct":
        return "struct{" + ";".join(f"{f[0]} {text(f[1])}" for f in t[1]) + "}"
    if k == "iface":
        return "interface{" + ";".join(sorted(f"{m[0]}{text(m[1])}" for m in t[1])) + "}"
    return f"{k}({','.join(text(x) if isinstance(x, list) else str(x) for x in t[1:])})"


class World:
    """Declarations of all packages by path, and questions about types."""

    def __init__(self, summaries: dict[str, list[tuple[str, dict]]]):
        self.funcs, self.types, self.vars, self.consts, self.methods = {}, {}, {}, {}, {}
        for pkg, files in summaries.items():
            for path, s in files:
                for kind, table in (("funcs", self.funcs), ("vars", self.vars), ("consts", self.consts), ("types", self.types)):
                    for name, d in s[kind].items():
                        table.setdefault(f"{pkg}.{name}", [path, *d])
                for t, pointer, name, sig, line, col in s["methods"]:
                    self.methods.setdefault(f"{pkg}.{t}", {})[name] = [path, pointer, sig, line, col]

    def underlying(self, t):
        seen = set()
        while t is not None and t[0] == "named":
            d = self.types.get(t[1])
            if d is None or t[1] in seen:
                return None
            seen.add(t[1])
            t = d[1]
        return ERROR if t == ["basic", "error"] else ["iface", [], []] if t in (["basic", "any"], ["basic", "comparable"]) else t

    def real(self, t):
        """Through aliases."""
        seen = set()
        while t and t[0] == "named" and t[1] not in seen:
            d = self.types.get(t[1])
            if d is None or not d[2]:
                break
            seen.add(t[1])
            t = d[1]
        return t

    def interface_methods(self, t, seen=frozenset()) -> dict[str, list]:
        u = self.underlying(t)
        if not u or u[0] != "iface" or text(t) in seen:
            return {}
        out = {m[0]: m[1] for m in u[1]}
        for e in u[2]:
            out |= self.interface_methods(e, seen | {text(t)})
        return out

    def method_set(self, t, seen=frozenset()) -> dict[str, tuple[bool, list, str]]:
        """name -> (needs a pointer, signature, qualified name), own methods first, then promoted ones."""
        t = self.real(t)
        if t is None or text(t) in seen:
            return {}
        out = {}
        if t[0] == "named":
            for name, (_, pointer, sig, _, _) in self.methods.get(t[1], {}).items():
                out[name] = (pointer, sig, f"({'*' if pointer else ''}{t[1]}).{name}")
        u = self.underlying(t)
        if u and u[0] == "iface":
            return {name: (False, sig, f"({text(t)}).{name}") for name, sig in self.interface_methods(t).items()}
        for name, ft, embedded, *_ in u[1] if u and u[0] == "struct" else ():
            if embedded:
                base, by_pointer = (ft[1], True) if ft and ft[0] == "ptr" else (ft, False)
                for m, (pointer, sig, qname) in self.method_set(base, seen | {text(t)}).items():
                    out.setdefault(m, (pointer and not by_pointer, sig, qname))
        return out

    def field(self, t, name: str, seen=frozenset()):
        """(owner, type, line, col) of a struct field, promoted ones too."""
        if t and t[0] == "ptr":
            t = t[1]
        t = self.real(t)
        u = self.underlying(t)
        if not u or u[0] != "struct" or text(t) in seen:
            return None
        for f in u[1]:
            if f[0] == name:
                return (t[1] if t[0] == "named" else text(t), f[1], f[3], f[4])
        for f in u[1]:
            if f[2]:
                found = self.field(f[1], name, seen | {text(t)})
                if found:
                    return found
        return None


class Obj:
    """What a name stands for: kind, type, object id, qualified name."""

    __slots__ = ("kind", "type", "id", "qname")

    def __init__(self, kind, type=None, id=None, qname=None):
        self.kind, self.type, self.id, self.qname = kind, type, id, qname


class Checker:
    """Walks the bodies of one file and emits (table, row)."""

    def __init__(self, world: World, pkg: str, path: str, tier: int, emit: Callable[[str, dict], None], order: int):
        self.w, self.pkg, self.path, self.tier, self.emit, self.order = world, pkg, path, tier, emit, order
        self.seq, self.scopes, self.fn, self.literals, self.selected = 0, [], None, 0, None

    # Scopes and emission

    def declare(self, n: Node, kind: str, t) -> None:
        if n.name == "_":
            return
        obj = Obj(kind, t, f"local:{self.path}:{n.line}:{n.col}", f"{self.pkg}.{n.name}")
        self.scopes[-1][n.name] = obj
        self.ident(n, obj, True)

    def ident(self, n: Node, obj: Obj, definition: bool = False) -> None:
        size = len(n.name.encode())
        kind = {"field": "var", "builtin": "", "nil": "", "pkg": ""}.get(obj.kind, obj.kind)
        self.emit("idents", {"file": self.path, "line": n.line, "col": n.col, "end_col": n.col + size, "obj_id": obj.id, "qname": obj.qname, "kind": kind, "is_def": definition})
        if not definition and obj.id is not None:
            self.emit("uses", {"obj_id": obj.id, "file": self.path, "line": n.line, "col": n.col, "pkg_path": self.pkg, "tier_rank": self.tier, "resolved": True})

    def unresolved(self, n: Node) -> None:
        self.emit("uses", {"obj_id": None, "file": self.path, "line": n.line, "col": n.col, "pkg_path": self.pkg, "tier_rank": self.tier, "resolved": False})

    def member(self, pkg: str, name: str) -> Obj | None:
        """A package-level object."""
        q = f"{pkg}.{name}"
        for kind, table in (("func", self.w.funcs), ("type", self.w.types), ("var", self.w.vars), ("const", self.w.consts)):
            if q in table:
                return Obj(kind, ["named", q, []] if kind == "type" else table[q][1], q, q)
        return None

    def lookup(self, name: str) -> Obj | None:
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        found = self.member(self.pkg, name)
        if found:
            return found
        if name in self.imports:
            return Obj("pkg", None, None, self.imports[name])
        if name in BASIC:
            return Obj("type", ["basic", name], None, name)
        if name in BUILTINS:
            return Obj("builtin", None, None, name)
        if name in ("true", "false", "iota"):
            return Obj("const", ["basic", "int" if name == "iota" else "bool"], None, name)
        return Obj("nil", None, None, "nil") if name == "nil" else None

    @property
    def types(self) -> Scope:
        local = {}
        for s in self.scopes:
            local |= {n: o.type for n, o in s.items() if o.kind == "type"}
        return Scope(self.pkg, self.imports, frozenset(), local)

    # Declarations

    def file(self, tree: Node) -> None:
        self.imports = imports_of(tree)
        for d in tree.decls:
            if d.kind == "Func":
                self.func(d)
            elif d.kind == "Type":
                self.package_type(d)
            else:
                self.package_values(d)

    def symbol(self, n: Node, kind: str, qname: str) -> None:
        self.emit("symbols", {"obj_id": qname, "kind": kind, "qname": qname, "sname": n.name, "pkg_path": self.pkg, "file": self.path, "line": n.line, "col": n.col, "tier_rank": self.tier, "load_order": self.order})
        self.ident(n, Obj(kind, None, qname, qname), True)

    def func(self, d: Node) -> None:
        params = {p.name.name: Obj("type", ["param", p.name.name]) for p in d.params}
        if d.receiver is None:
            qname, kind = f"{self.pkg}.{d.name.name}", "func"
        else:
            t, pointer, names = receiver(d.receiver)
            qname, kind = f"({'*' if pointer else ''}{self.pkg}.{t}).{d.name.name}", "method"
            params |= {n: Obj("type", ["param", n]) for n in names}
        if d.name.name != "_" and not (kind == "func" and d.name.name == "init"):
            self.symbol(d.name, kind, qname)
        self.emit("functions", {"fn_id": f"{qname}@{self.path}", "qname": qname, "variant": "test" if self.path.endswith("_test.go") else "regular", "synthetic": False})
        self.scopes = [params]
        for p in d.params:
            self.type_expr(p.type)
        self.fn, self.literals = qname, 0
        self.function(d.sig, d.body, [d.receiver] if d.receiver else [])
        self.scopes, self.fn = [], None

    def function(self, sig: Node, body: Node | None, first: list[Node] = ()) -> None:
        """Parameters and body in a scope of their own."""
        self.scopes.append({})
        for p in [*first, *sig.params, *sig.results]:
            self.type_expr(p.type)
            if p.name is not None:
                t = self.types.type(p.type)
                self.declare(p.name, "var", ["slice", t] if p.variadic else t)
        if body is not None:
            self.statements(body.stmts)
        self.scopes.pop()

    def package_type(self, d: Node) -> None:
        qname = f"{self.pkg}.{d.name.name}"
        self.symbol(d.name, "type", qname)
        self.scopes = [{p.name.name: Obj("type", ["param", p.name.name]) for p in d.params}]
        self.type_expr(d.type, qname)
        self.scopes = []
        if d.alias:
            return
        t = ["named", qname, []]
        u = self.w.underlying(t)
        is_interface = bool(u) and u[0] == "iface"
        self.emit("named_types", {"type_id": qname, "qname": qname, "pkg_path": self.pkg, "is_interface": is_interface, "file": self.path, "line": d.name.line, "col": d.name.col, "tier_rank": self.tier})
        if is_interface:
            for name, sig in self.w.interface_methods(t).items():
                self.emit("iface_methods", {"type_id": qname, "name": name, "signature": self.signature(name, sig)})
            return
        for name, (pointer, sig, fn) in self.w.method_set(t).items():
            self.emit("method_sets", {"type_id": qname, "via_pointer": pointer, "name": name, "signature": self.signature(name, sig), "fn_qname": fn})
        if d.type.kind == "StructType":
            for f in d.type.fields:
                for n in f.names:
                    exported = n.name[:1].isupper()
                    self.emit("struct_fields", {"struct_qname": qname, "go_field": n.name, "tag": f.tag, "exported": exported, "obj_id": f"field:{qname}.{n.name}", "pkg_path": self.pkg, "tier_rank": self.tier, "load_order": self.order * 100_000 + n.line})

    def signature(self, name: str, sig) -> str:
        """Text that decides satisfaction; unexported methods are those of their package."""
        return text(sig) if name[:1].isupper() else f"{self.pkg}:{text(sig)}"

    def package_values(self, d: Node) -> None:
        self.fn = f"{self.pkg}.init"
        self.scopes = [{}]
        for n in d.names:
            if n.name != "_":
                self.symbol(n, "var" if d.kind == "Var" else "const", f"{self.pkg}.{n.name}")
        self.type_expr(d.type)
        for v in d.values:
            self.expr(v)
        self.scopes, self.fn = [], None

    # Types in source

    def type_expr(self, n: Node | None, owner: str | None = None) -> None:
        """Uses inside a type expression; fields and methods of a declared type are defined by ``owner``."""
        if n is None:
            return
        if n.kind in ("Ident", "Selector"):
            self.expr(n)
        elif n.kind == "Index":
            self.type_expr(n.x)
            for a in n.args:
                self.type_expr(a)
        elif n.kind == "StructType":
            for f in n.fields:
                for name in f.names:
                    q = f"{owner}.{name.name}" if owner else None
                    self.ident(name, Obj("field", None, f"field:{q}" if q else f"local:{self.path}:{name.line}:{name.col}", f"{self.pkg}.{name.name}"), True)
                self.type_expr(f.type)
        elif n.kind == "InterfaceType":
            for m in n.methods:
                q = f"({owner}).{m.name.name}" if owner else None
                self.ident(m.name, Obj("method", None, f"iface:{q}", q), True)
                self.type_expr(m.sig)
            for e in n.embedded:
                self.type_expr(e)
        elif n.kind == "FuncType":
            for p in [*n.params, *n.results]:
                self.type_expr(p.type)
        elif n.kind == "ArrayType" and n.size is not None:
            self.expr(n.size)
            self.type_expr(n.elem)
        else:
            for c in n.children():
                self.type_expr(c)

    # Statements

    def statements(self, stmts: list[Node]) -> None:
        for s in stmts:
            self.statement(s)

    def scoped(self, run: Callable[[], None]) -> None:
        self.scopes.append({})
        run()
        self.scopes.pop()

    def statement(self, s: Node | None) -> None:
        if s is None:
            return
        handler = getattr(self, f"do_{s.kind}", None)
        if handler:
            handler(s)
            return
        for c in s.children():
            self.statement(c) if c.kind in ("Block", "If", "For", "Switch", "Select") else self.expr(c)

    def do_Block(self, s: Node) -> None:
        self.scoped(lambda: self.statements(s.stmts))

    def do_DeclStmt(self, s: Node) -> None:
        for d in s.specs:
            if d.kind == "Type":
                q = f"{self.pkg}.{d.name.name}"
                obj = Obj("type", ["named", q + f"·{d.name.line}", []], f"local:{self.path}:{d.name.line}:{d.name.col}", q)
                self.scopes[-1][d.name.name] = obj
                self.ident(d.name, obj, True)
                self.w.types[obj.type[1]] = [self.path, self.types.type(d.type), d.alias, d.name.line, d.name.col, []]
                self.type_expr(d.type, q)
                continue
            self.type_expr(d.type)
            found = [self.expr(v) for v in d.values]
            t = self.types.type(d.type)
            if len(found) == 1 and len(d.names) > 1:
                found = self.several(found[0], len(d.names))
            for k, n in enumerate(d.names):
                self.declare(n, "var" if d.kind == "Var" else "const", t or (found[k] if k < len(found) else None))

    @staticmethod
    def several(t, count: int) -> list:
        """Types that one value of several gives its names."""
        if t and t[0] == "tuple":
            return t[1] + [None] * (count - len(t[1]))
        return [t] + [["basic", "bool"]] * (count - 1)

    def do_Assign(self, s: Node) -> None:
        if s.op != ":=":
            for x in s.left:
                if not (x.kind == "Ident" and x.name == "_"):
                    self.expr(x)
            for x in s.right:
                self.expr(x)
            return
        found = [self.expr(x) for x in s.right]
        if len(found) == 1 and len(s.left) > 1:
            found = self.several(found[0], len(s.left))
        for n, t in zip(s.left, found):
            if n.kind == "Ident" and n.name in self.scopes[-1]:
                self.ident(n, self.scopes[-1][n.name])
            elif n.kind == "Ident":
                self.declare(n, "var", t)

    def do_If(self, s: Node) -> None:
        def run():
            self.statement(s.init)
            self.statement(s.cond)
            self.do_Block(s.body)
            self.statement(s.other)

        self.scoped(run)

    def do_For(self, s: Node) -> None:
        def run():
            for part in (s.init, s.cond, s.post):
                self.statement(part)
            self.do_Block(s.body)

        self.scoped(run)

    def do_Range(self, s: Node) -> None:
        t = self.w.underlying(self.expr(s.x))
        key = value = None
        if t:
            if t[0] == "ptr":
                t = self.w.underlying(t[1]) or t
            if t[0] in ("slice", "array"):
                key, value = ["basic", "int"], t[1]
            elif t[0] == "map":
                key, value = t[1], t[2]
            elif t[0] == "chan":
                key = t[1]
            elif t[0] == "basic":
                key, value = ["basic", "int"], ["basic", "rune"]
            elif t[0] == "func" and t[1] and t[1][0] and t[1][0][0] == "func":
                key, value = (t[1][0][1] + [None, None])[:2]
        for n, k in zip(s.names, (key, value)):
            if s.define and n.kind == "Ident":
                self.declare(n, "var", k)
            elif not (n.kind == "Ident" and n.name == "_"):
                self.expr(n)

    def do_Switch(self, s: Node) -> None:
        def run():
            self.statement(s.init)
            tag, bound, guard = s.tag, None, None
            if tag is not None and tag.kind == "Assign" and tag.right and tag.right[0].kind == "TypeAssert" and tag.right[0].type is None:
                bound, guard = tag.left[0], tag.right[0]
            elif tag is not None and tag.kind == "ExprStmt" and tag.x.kind == "TypeAssert" and tag.x.type is None:
                guard = tag.x
            if guard is None:
                self.statement(tag)
            else:
                held = self.expr(guard.x)
            for c in s.clauses:
                self.scopes.append({})
                for v in c.values:
                    self.type_expr(v) if guard is not None and not (v.kind == "Ident" and v.name == "nil") else self.expr(v)
                if bound is not None:
                    t = self.types.type(c.values[0]) if len(c.values) == 1 else held
                    self.declare(bound, "var", t)
                self.statements(c.stmts)
                self.scopes.pop()

        self.scoped(run)

    def do_Select(self, s: Node) -> None:
        for c in s.clauses:
            self.scopes.append({})
            for v in c.values:
                self.statement(v)
            self.statements(c.stmts)
            self.scopes.pop()

    # Expressions: each returns its type

    def expr(self, n: Node | None):
        if n is None:
            return None
        self.seq += 1
        handler = getattr(self, f"of_{n.kind}", None)
        if handler:
            t = handler(n)
            self.taken(n)
            return t
        if n.kind.endswith("Type"):
            self.type_expr(n)
            return self.types.type(n)
        for c in n.children():
            self.expr(c)
        return None

    def taken(self, n: Node) -> None:
        """A function named outside a call's callee is a value that may be called later."""
        obj = self.lookup(n.name) if n.kind == "Ident" else self.selected if n.kind == "Selector" else None
        if obj is not None and obj.kind in ("func", "method") and obj.id and not obj.id.startswith("iface:") and obj.type:
            self.emit("func_values", {"taker": self.fn, "fn": obj.qname, "signature": text(obj.type)})

    def of_Ident(self, n: Node):
        if n.name == "_":
            return None
        obj = self.lookup(n.name)
        if obj is None:
            self.unresolved(n)
            return None
        self.ident(n, obj)
        return obj.type

    def of_Literal(self, n: Node):
        return literal_type(n, self.types)

    def of_Paren(self, n: Node):
        return self.expr(n.x)

    def of_Star(self, n: Node):
        t = self.expr(n.x)
        if self.is_type(n.x):
            return ["ptr", t]
        u = self.w.underlying(t)
        return u[1] if u and u[0] == "ptr" else None

    def of_Unary(self, n: Node):
        t = self.expr(n.x)
        if n.op == "&":
            return ["ptr", t]
        if n.op == "<-":
            u = self.w.underlying(t)
            return u[1] if u and u[0] == "chan" else None
        return ["basic", "bool"] if n.op == "!" else t

    def of_Binary(self, n: Node):
        a, b = self.expr(n.x), self.expr(n.y)
        return ["basic", "bool"] if n.op in ("==", "!=", "<", "<=", ">", ">=", "&&", "||") else a or b

    def of_FuncLit(self, n: Node):
        held, self.literals = (self.fn, self.literals), self.literals + 1
        outer = self.fn
        self.fn = f"{outer}${self.literals}"
        self.emit("functions", {"fn_id": f"{self.fn}@{self.path}", "qname": self.fn, "variant": "regular", "synthetic": False})
        self.emit("func_values", {"taker": outer, "fn": self.fn, "signature": text(self.types.type(n.sig))})
        self.function(n.sig, n.body)
        self.fn = held[0]
        return self.types.type(n.sig)

    def of_Composite(self, n: Node, kind=None):
        if n.type is not None:
            self.type_expr(n.type)
            kind = self.types.type(n.type)
        real = self.w.real(kind)
        if real and real[0] == "named":
            self.emit("instantiations", {"fn": self.fn, "type_id": real[1]})
        u = self.w.underlying(kind[1] if kind and kind[0] == "ptr" else kind)
        elem = u[2] if u and u[0] == "map" else u[1] if u and u[0] in ("slice", "array") else None
        for item in n.items:
            value = item
            if item.kind == "KeyValue":
                value = item.value
                if u and u[0] == "struct" and item.key.kind == "Ident":
                    self.use_field(kind, item.key)
                    found = self.w.field(kind, item.key.name)
                    if value.kind == "Composite" and value.type is None:
                        self.of_Composite(value, found[1] if found else None)
                        continue
                elif item.key.kind == "Composite" and item.key.type is None:
                    self.of_Composite(item.key, u[1] if u and u[0] == "map" else None)
                else:
                    self.expr(item.key)
            if value.kind == "Composite" and value.type is None:
                self.of_Composite(value, elem)
            else:
                self.expr(value)
        return kind

    def use_field(self, t, n: Node):
        found = self.w.field(t, n.name)
        if not found:
            self.unresolved(n)
            return None
        self.ident(n, Obj("field", found[1], f"field:{found[0]}.{n.name}", f"{self.pkg}.{n.name}"))
        return found[1]

    def of_Selector(self, n: Node):
        self.selected = None
        if n.x.kind == "Ident":
            base = self.lookup(n.x.name)
            if base is not None and base.kind == "pkg":
                obj = self.member(base.qname, n.sel.name)
                if obj is None:
                    obj = Obj("func", None, f"{base.qname}.{n.sel.name}", f"{base.qname}.{n.sel.name}")
                self.ident(n.sel, obj)
                self.selected = obj
                return obj.type
        t = self.expr(n.x)
        obj = self.method(t, n.sel.name)
        if obj is None:
            self.selected = None
            ft = self.use_field(t, n.sel)
            found = self.w.field(t, n.sel.name)
            if found:
                self.selected = Obj("field", ft, f"field:{found[0]}.{n.sel.name}", f"{self.pkg}.{n.sel.name}")
            return ft
        self.ident(n.sel, obj)
        self.selected = obj
        return obj.type

    def method(self, t, name: str) -> Obj | None:
        base = t[1] if t and t[0] == "ptr" else t
        base = self.w.real(base)
        if not base:
            return None
        found = self.w.method_set(base).get(name)
        if not found:
            return None
        u = self.w.underlying(base)
        abstract = bool(u) and u[0] == "iface"
        obj = Obj("method", found[1], f"iface:{found[2]}" if abstract else found[2], found[2])
        return obj

    def of_Index(self, n: Node):
        t = self.expr(n.x)
        for a in n.args:
            self.expr(a)
        if self.is_type(n.x) and t and t[0] == "named":
            return ["named", t[1], [self.types.type(a) for a in n.args]]
        u = self.w.underlying(t)
        if not u:
            return None
        if u[0] == "ptr":
            u = self.w.underlying(u[1]) or u
        return u[2] if u[0] == "map" else u[1] if u[0] in ("slice", "array") else ["basic", "byte"] if u[0] == "basic" else t

    def of_SliceExpr(self, n: Node):
        t = self.expr(n.x)
        for a in n.args:
            self.expr(a)
        u = self.w.underlying(t)
        return ["slice", u[1]] if u and u[0] == "array" else t

    def of_TypeAssert(self, n: Node):
        seq = self.seq
        self.expr(n.x)
        if n.type is None:
            return None
        self.type_expr(n.type)
        t = self.types.type(n.type)
        self.node("typeassert", n, seq, None, None, False, t)
        return t

    def node(self, kind: str, n: Node, seq: int, callee, n_args, is_type: bool, t) -> None:
        pointer = bool(t) and t[0] == "ptr"
        target = self.w.real(t[1] if pointer else t)
        named = target[1] if target and target[0] == "named" else None
        self.emit("ast_nodes", {
            "kind": kind, "pkg_path": self.pkg, "file": self.path, "line": n.line, "col": n.col, "visit_seq": seq, "callee_qname": callee, "n_args": n_args,
            "fun_is_type": is_type, "target_qname": named, "target_is_ptr": pointer, "enclosing_fn": self.fn, "tier_rank": self.tier,
        })

    def is_type(self, n: Node) -> bool:
        """Whether an expression denotes a type."""
        if n.kind in ("Paren", "Star"):
            return self.is_type(n.x)
        if n.kind == "Ident":
            obj = self.lookup(n.name)
            return obj is not None and obj.kind == "type"
        if n.kind == "Selector" and n.x.kind == "Ident":
            base = self.lookup(n.x.name)
            if base is not None and base.kind == "pkg":
                obj = self.member(base.qname, n.sel.name)
                return obj is not None and obj.kind == "type"
        if n.kind == "Index":
            return self.is_type(n.x)
        return n.kind.endswith("Type")

    def of_Call(self, n: Node):
        seq, fun = self.seq, n.fun
        is_type = self.is_type(fun)
        callee, selected, t = None, None, None
        if fun.kind == "Ident":
            obj = self.lookup(fun.name)
            if obj is not None:
                self.ident(fun, obj)
                callee, selected, t = obj.qname, obj, obj.type
            else:
                self.unresolved(fun)
        elif fun.kind == "Selector":
            self.seq += 1
            t = self.of_Selector(fun)
            selected = self.selected
            callee = selected.qname if selected else None
        elif is_type:
            self.type_expr(fun)
            t = self.types.type(fun.x if fun.kind == "Paren" else fun)
        else:
            t = self.expr(fun)
        if is_type and fun.kind in ("Ident", "Selector", "Index", "Paren"):
            t = self.types.type(fun.x if fun.kind == "Paren" else fun)
        self.node("call", n, seq, callee, len(n.args), is_type, t if is_type else None)
        found = [self.expr(a) for a in n.args]
        if is_type:
            return t
        name = fun.name if fun.kind == "Ident" else None
        if selected is not None and selected.kind == "builtin":
            return self.builtin(name, n, found)
        self.edge(n, fun, selected, t)
        u = self.w.underlying(t)
        if not u or u[0] != "func":
            return None
        return u[2][0] if len(u[2]) == 1 else ["tuple", u[2]]

    def builtin(self, name: str, n: Node, found: list):
        if name in ("len", "cap", "copy"):
            return ["basic", "int"]
        if name == "new" and n.args:
            t = self.types.type(n.args[0])
            if t and t[0] == "named":
                self.emit("instantiations", {"fn": self.fn, "type_id": t[1]})
            return ["ptr", t]
        if name == "make" and n.args:
            return self.types.type(n.args[0])
        return found[0] if name in ("append", "min", "max") and found else None

    def edge(self, n: Node, fun: Node, selected: Obj | None, t) -> None:
        """Call-graph facts of a call: a static edge, an interface site, or a function-value site."""
        at = {"file": self.path, "line": n.paren.line, "col": n.paren.col}
        if selected is not None and selected.kind in ("func", "method") and selected.id and not selected.id.startswith("iface:"):
            self.emit("call_edges", {"caller": self.fn, "callee": selected.qname, **at, "dispatch": "static"})
        elif selected is not None and selected.kind == "method":
            owner = selected.qname[1 : selected.qname.rindex(")")]
            self.emit("dyn_sites", {"caller": self.fn, "iface_type_id": owner, "method": fun.sel.name, "signature": self.signature(fun.sel.name, selected.type), **at})
        elif fun.kind == "FuncLit" or (fun.kind == "Paren" and fun.x.kind == "FuncLit"):
            self.emit("call_edges", {"caller": self.fn, "callee": f"{self.fn}${self.literals}", **at, "dispatch": "static"})
        else:
            u = self.w.underlying(t)
            if u and u[0] == "func":
                self.emit("func_sites", {"caller": self.fn, "signature": text(u), **at})


def check(world: World, pkg: str, path: str, tree: Node, tier: int, order: int, emit: Callable[[str, dict], None]) -> None:
    Checker(world, pkg, path, tier, emit, order).file(tree)
