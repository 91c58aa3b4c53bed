"""Syntax trees of Go files, by recursive descent."""

from __future__ import annotations

from typing import Any

from .lexer import SyntaxFault, Token, tokens

_LEVELS = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset(["=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="])


class Node:
    """A node: its kind, the place where it begins, and its parts by name."""

    def __init__(self, kind: str, at: Token | Node, **parts: Any):
        self.kind, self.line, self.col = kind, at.line, at.col
        self.__dict__.update(parts)

    def __getattr__(self, name: str) -> Any:  # a part that this kind doesn't have
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def children(self):
        """Nodes below, in source order of the parts."""
        for value in list(self.__dict__.values()):
            if isinstance(value, Node):
                yield value
            elif isinstance(value, list):
                yield from (x for x in value if isinstance(x, Node))


class Parser:
    def __init__(self, source: str):
        self.toks, self.k, self.level = tokens(source), 0, 0

    # Tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.k]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.k + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind in ("op", "keyword")

    def take(self) -> Token:
        t = self.tok
        self.k += 1
        return t

    def eat(self, text: str) -> Token | None:
        return self.take() if self.at(text) else None

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxFault(f"{self.tok.line}:{self.tok.col}: {self.tok.text!r} where {text!r} was due")
        return self.take()

    def name(self) -> Node:
        if self.tok.kind != "name":
            raise SyntaxFault(f"{self.tok.line}:{self.tok.col}: {self.tok.text!r} where a name was due")
        t = self.take()
        return Node("Ident", t, name=t.text)

    def end_of_statement(self) -> None:
        if not self.at(")", "}"):
            self.need(";")

    def group(self, one) -> list:
        """``x`` or ``( x; x; ... )``."""
        if not self.eat("("):
            return [one()]
        out = []
        while not self.at(")"):
            out.append(one())
            self.end_of_statement()
        self.need(")")
        return out

    # Files and declarations

    def file(self) -> Node:
        start = self.need("package")
        name = self.name()
        self.end_of_statement()
        imports, decls = [], []
        while self.at("import"):
            self.take()
            imports += self.group(self.import_spec)
            self.end_of_statement()
        while self.tok.kind != "end":
            if self.at("func"):
                decls.append(self.func_decl())
            else:
                decls += self.gen_decl()
            if self.tok.kind != "end":
                self.need(";")
        return Node("File", start, name=name.name, imports=imports, decls=decls)

    def import_spec(self) -> Node:
        at, alias = self.tok, None
        if self.tok.kind == "name" or self.at("."):
            alias = self.take().text
        return Node("Import", at, alias=alias, path=self.take().text[1:-1])

    def gen_decl(self) -> list[Node]:
        word = self.take().text
        if word == "type":
            return self.group(self.type_spec)
        if word not in ("var", "const"):
            raise SyntaxFault(f"{self.tok.line}:{self.tok.col}: {word!r} where a declaration was due")
        before: list = [None, []]

        def spec() -> Node:
            at, names, kind, values = self.tok, [self.name()], None, []
            while self.eat(","):
                names.append(self.name())
            if not self.at("=", ";", ")", "}"):
                kind = self.type()
            if self.eat("="):
                values = self.exprs()
            if word == "const":
                if kind or values:
                    before[0], before[1] = kind, values
                else:
                    kind = before[0]  # repeats the one above
            return Node("Const" if word == "const" else "Var", at, names=names, type=kind, values=values)

        return self.group(spec)

    def type_spec(self) -> Node:
        name, params = self.name(), []
        if self.at("[") and self.peek().kind == "name" and not (self.peek(2).text == "]" and self.peek(2).kind == "op"):
            params = self.type_params()
        alias = bool(self.eat("="))
        return Node("Type", name, name=name, params=params, alias=alias, type=self.type())

    def type_params(self) -> list[Node]:
        self.need("[")
        out: list[Node] = []
        while not self.at("]"):
            names = [self.name()]
            while self.eat(","):
                names.append(self.name())
            bound = self.constraint()
            out += [Node("Param", n, name=n, type=bound) for n in names]
            if not self.eat(","):
                break
        self.need("]")
        return out

    def constraint(self) -> Node:
        at, parts = self.tok, []
        while True:
            self.eat("~")
            parts.append(self.type())
            if not self.eat("|"):
                return parts[0] if len(parts) == 1 else Node("UnionType", at, parts=parts)

    def func_decl(self) -> Node:
        at = self.need("func")
        receiver = None
        if self.at("("):
            got = self.params()
            receiver = got[0] if got else None
        name = self.name()
        params = self.type_params() if self.at("[") else []
        sig = self.signature(at)
        body = self.body() if self.at("{") else None
        return Node("Func", at, receiver=receiver, name=name, params=params, sig=sig, body=body)

    def body(self) -> Node:
        held, self.level = self.level, 0
        out = self.block()
        self.level = held
        return out

    def signature(self, at) -> Node:
        params, results = self.params(), []
        if self.at("("):
            results = self.params()
        elif self.tok.kind == "name" or self.at("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            t = self.type()
            results = [Node("Param", t, name=None, type=t)]
        return Node("FuncType", at, params=params, results=results)

    def params(self) -> list[Node]:
        self.need("(")
        entries = []  # (type or name, type after it, variadic)
        while not self.at(")"):
            at, variadic = self.tok, bool(self.eat("..."))
            first = self.type()
            second = None
            if not self.at(",", ")") and not variadic:
                variadic = bool(self.eat("..."))
                second = self.type()
            entries.append((at, first, second, variadic))
            if not self.eat(","):
                break
        self.need(")")
        out = []
        if any(e[2] for e in entries):  # names are given: those without a type share the next one
            kind = variadic = None
            for at, first, second, rest in reversed(entries):
                if second is not None:
                    kind, variadic = second, rest
                out.append(Node("Param", at, name=Node("Ident", at, name=first.name), type=kind, variadic=variadic))
            return out[::-1]
        return [Node("Param", at, name=None, type=first, variadic=rest) for at, first, _, rest in entries]

    # Types

    def type(self) -> Node:
        t = self.tok
        if t.kind == "name":
            return self.type_name()
        if self.eat("*"):
            return Node("Star", t, x=self.type())
        if self.eat("("):
            inner = self.type()
            self.need(")")
            return inner
        if self.eat("["):
            if self.eat("]"):
                return Node("SliceType", t, elem=self.type())
            size = None if self.eat("...") else self.inner_expr()
            self.need("]")
            return Node("ArrayType", t, size=size, elem=self.type())
        if self.eat("map"):
            self.need("[")
            key = self.type()
            self.need("]")
            return Node("MapType", t, key=key, elem=self.type())
        if self.at("chan", "<-"):
            if self.take().text == "<-":
                self.need("chan")
            self.eat("<-")
            return Node("ChanType", t, elem=self.type())
        if self.eat("func"):
            return self.signature(t)
        if self.eat("struct"):
            return self.struct_type(t)
        if self.eat("interface"):
            return self.interface_type(t)
        raise SyntaxFault(f"{t.line}:{t.col}: {t.text!r} where a type was due")

    def type_name(self) -> Node:
        x = self.name()
        if self.at(".") and self.peek().kind == "name":
            self.take()
            x = Node("Selector", x, x=x, sel=self.name())
        if self.at("[") and not (self.peek().text == "]" and self.peek().kind == "op"):
            self.take()
            args = [self.type()]
            while self.eat(",") and not self.at("]"):
                args.append(self.type())
            self.need("]")
            x = Node("Index", x, x=x, args=args)
        return x

    def struct_type(self, at: Token) -> Node:
        self.need("{")
        fields = []
        while not self.at("}"):
            start, star = self.tok, bool(self.eat("*"))
            embedded = star or self.peek().text in (".", ";", "}") or self.peek().kind == "string"
            if embedded:
                t = self.type_name()
                names, kind = [], Node("Star", start, x=t) if star else t
            else:
                names = [self.name()]
                while self.eat(","):
                    names.append(self.name())
                kind = self.type()
            tag = self.take().text if self.tok.kind == "string" else None
            fields.append(Node("Field", start, names=names, type=kind, tag=tag))
            self.end_of_statement()
        self.need("}")
        return Node("StructType", at, fields=fields)

    def interface_type(self, at: Token) -> Node:
        self.need("{")
        methods, embedded = [], []
        while not self.at("}"):
            if self.tok.kind == "name" and self.peek().text == "(":
                name = self.name()
                methods.append(Node("Method", name, name=name, sig=self.signature(name)))
            else:
                embedded.append(self.constraint())
            self.end_of_statement()
        self.need("}")
        return Node("InterfaceType", at, methods=methods, embedded=embedded)

    # Expressions

    def exprs(self) -> list[Node]:
        out = [self.expr()]
        while self.eat(","):
            out.append(self.expr())
        return out

    def inner_expr(self) -> Node:
        """An expression inside brackets, where composite literals are free again."""
        held, self.level = self.level, 0
        x = self.expr()
        self.level = held
        return x

    def expr(self, least: int = 1) -> Node:
        x = self.unary()
        while self.tok.kind == "op" and _LEVELS.get(self.tok.text, 0) >= least:
            op = self.take().text
            x = Node("Binary", x, op=op, x=x, y=self.expr(_LEVELS[op] + 1))
        return x

    def unary(self) -> Node:
        t = self.tok
        if self.at("*"):
            self.take()
            return Node("Star", t, x=self.unary())
        if self.at("<-") and self.peek().text == "chan":
            return self.primary(self.type())
        if self.at("+", "-", "!", "^", "&", "<-", "~"):
            op = self.take().text
            return Node("Unary", t, op=op, x=self.unary())
        return self.primary(self.operand())

    def operand(self) -> Node:
        t = self.tok
        if t.kind in ("number", "string", "char"):
            self.take()
            return Node("Literal", t, what=t.kind, text=t.text)
        if t.kind == "name":
            return self.name()
        if self.eat("("):
            held, self.level = self.level, 0
            x = self.type() if self.at("chan", "map", "struct", "interface") else self.expr()
            self.level = held
            self.need(")")
            return Node("Paren", t, x=x)
        if self.at("func"):
            self.take()
            sig = self.signature(t)
            return Node("FuncLit", t, sig=sig, body=self.body()) if self.at("{") else sig
        if self.at("[", "map", "chan", "struct", "interface"):
            return self.type()
        raise SyntaxFault(f"{t.line}:{t.col}: {t.text!r} where an operand was due")

    def primary(self, x: Node) -> Node:
        while True:
            if self.at("."):
                self.take()
                if self.eat("("):
                    kind = None if self.eat("type") else self.type()
                    self.need(")")
                    x = Node("TypeAssert", x, x=x, type=kind)
                else:
                    x = Node("Selector", x, x=x, sel=self.name())
            elif self.at("["):
                x = self.index(x)
            elif self.at("("):
                paren = self.take()
                held, self.level = self.level, 0
                args, spread = [], False
                while not self.at(")"):
                    args.append(self.expr())
                    spread = bool(self.eat("...")) or spread
                    if not self.eat(","):
                        break
                self.level = held
                self.need(")")
                x = Node("Call", x, fun=x, args=args, spread=spread, paren=Node("Pos", paren))
            elif self.at("{") and self.literal_type(x):
                x = self.composite(x)
            else:
                return x

    def literal_type(self, x: Node) -> bool:
        if x.kind in ("SliceType", "ArrayType", "MapType", "StructType"):
            return True
        named = x.kind == "Ident" or (x.kind == "Selector" and x.x.kind == "Ident") or (x.kind == "Index" and x.x.kind in ("Ident", "Selector"))
        return named and self.level >= 0

    def index(self, x: Node) -> Node:
        self.need("[")
        held, self.level = self.level, 0
        parts, colons = [], 0
        while not self.at("]"):
            if self.eat(":"):
                colons += 1
            elif self.eat(","):
                continue
            else:
                parts.append(self.expr())
        self.level = held
        self.need("]")
        return Node("SliceExpr", x, x=x, args=parts) if colons else Node("Index", x, x=x, args=parts)

    def composite(self, kind: Node | None) -> Node:
        at = self.need("{")
        held, self.level = self.level, 0
        items = []
        while not self.at("}"):
            items.append(self.element())
            if not self.eat(","):
                break
        self.eat(";")
        self.level = held
        self.need("}")
        return Node("Composite", kind or at, type=kind, items=items)

    def element(self) -> Node:
        first = self.composite(None) if self.at("{") else self.expr()
        if self.eat(":"):
            value = self.composite(None) if self.at("{") else self.expr()
            return Node("KeyValue", first, key=first, value=value)
        return first

    # Statements

    def block(self) -> Node:
        at = self.need("{")
        out = self.statements()
        self.need("}")
        return Node("Block", at, stmts=out)

    def statements(self) -> list[Node]:
        out = []
        while not self.at("}", "case", "default") and self.tok.kind != "end":
            s = self.statement()
            if s is not None:
                out.append(s)
            if not self.at("}", "case", "default"):
                self.need(";")
        return out

    def statement(self) -> Node | None:
        t = self.tok
        if self.at(";"):
            return None
        if self.at("var", "const", "type"):
            return Node("DeclStmt", t, specs=self.gen_decl())
        if self.at("{"):
            return self.block()
        if self.at("if"):
            return self.if_stmt()
        if self.at("for"):
            return self.for_stmt()
        if self.at("switch"):
            return self.switch_stmt()
        if self.at("select"):
            self.take()
            self.need("{")
            return Node("Select", t, clauses=self.clauses(True))
        if self.at("return"):
            self.take()
            return Node("Return", t, values=[] if self.at(";", "}") else self.exprs())
        if self.at("go", "defer"):
            word = self.take().text
            return Node("Go", t, word=word, x=self.expr())
        if self.at("break", "continue", "goto", "fallthrough"):
            self.take()
            if self.tok.kind == "name":
                self.take()
            return Node("Branch", t)
        if t.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
            self.take()
            self.take()
            return self.statement() if not self.at("}") else None
        return self.simple()

    def simple(self, ranged: bool = False) -> Node:
        t = self.tok
        if ranged and self.at("range"):
            self.take()
            return Node("Range", t, names=[], define=False, x=self.expr())
        left = self.exprs()
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            op = self.take().text
            if ranged and self.at("range"):
                self.take()
                return Node("Range", t, names=left, define=op == ":=", x=self.expr())
            return Node("Assign", t, op=op, left=left, right=self.exprs())
        if self.at("++", "--"):
            self.take()
            return Node("ExprStmt", t, x=left[0])
        if self.eat("<-"):
            return Node("Send", t, x=left[0], value=self.expr())
        return Node("ExprStmt", t, x=left[0])

    def if_stmt(self) -> Node:
        t = self.need("if")
        held, self.level = self.level, -1
        init, cond = None, None
        if not self.at(";"):
            cond = self.simple()
        if self.eat(";"):
            init, cond = cond, self.simple()
        self.level = held
        body, other = self.block(), None
        if self.eat("else"):
            other = self.if_stmt() if self.at("if") else self.block()
        return Node("If", t, init=init, cond=cond, body=body, other=other)

    def for_stmt(self) -> Node:
        t = self.need("for")
        held, self.level = self.level, -1
        init = cond = post = None
        if not self.at("{"):
            if not self.at(";"):
                cond = self.simple(True)
            if self.at(";") and (cond is None or cond.kind != "Range"):
                self.take()
                init, cond = cond, None
                if not self.at(";", "{"):
                    cond = self.simple()
                if self.eat(";") and not self.at("{"):
                    post = self.simple()
        self.level = held
        return Node("For", t, init=init, cond=cond, post=post, body=self.block())

    def switch_stmt(self) -> Node:
        t = self.need("switch")
        held, self.level = self.level, -1
        init = tag = None
        if not self.at("{"):
            if not self.at(";"):
                tag = self.simple()
            if self.eat(";"):
                init, tag = tag, None
                if not self.at("{"):
                    tag = self.simple()
        self.level = held
        self.need("{")
        return Node("Switch", t, init=init, tag=tag, clauses=self.clauses(False))

    def clauses(self, comm: bool) -> list[Node]:
        out = []
        while not self.at("}"):
            t, values = self.tok, []
            if self.eat("default") is None:
                self.need("case")
                if comm:
                    values = [self.simple()]
                else:
                    values = [self.case_item()]
                    while self.eat(","):
                        values.append(self.case_item())
            self.need(":")
            out.append(Node("Clause", t, values=values, stmts=self.statements()))
        self.need("}")
        return out

    def case_item(self) -> Node:
        return self.type() if self.at("chan", "map", "struct", "interface") else self.expr()


def parse(source: str) -> Node:
    return Parser(source).file()
