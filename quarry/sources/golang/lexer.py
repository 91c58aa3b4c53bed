"""Tokens of Go source, with the semicolons that line ends stand for.  Columns count bytes."""

from __future__ import annotations

import re
from typing import NamedTuple

#: The language's keywords.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<name>[^\W\d]\w*)
    |(?P<number>0[xX][0-9a-fA-F_.pP+-]+|0[bBoO][0-9_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?)
    |(?P<string>`[^`]*`|"(?:[^"\\\n]|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.[^']*)')
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])
    |(?P<other>.)""",
    re.X | re.S,
)

_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


class Token(NamedTuple):
    kind: str  # name, keyword, number, string, char, op, end
    text: str
    line: int
    col: int


class SyntaxFault(ValueError):
    pass


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    line, start, last = 1, 0, ""
    wide = not source.isascii()

    def column(at: int) -> int:
        return (len(source[start:at].encode()) if wide else at - start) + 1

    def close(at: int) -> None:
        nonlocal last
        if out and (out[-1].kind in ("name", "number", "string", "char") or last in _ENDS):
            out.append(Token("op", ";", line, column(at)))
        last = ""

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "newline":
            if last != "" or (out and out[-1].kind in ("name", "number", "string", "char") and last != ";"):
                close(m.start())
            line, start = line + 1, m.end()
            continue
        if kind == "comment":
            if "\n" in text:
                close(m.start())
                line, start = line + text.count("\n"), m.start() + text.rindex("\n") + 1
            continue
        if kind == "other":
            raise SyntaxFault(f"{line}:{column(m.start())}: unexpected {text!r}")
        if kind == "name" and text in KEYWORDS:
            kind = "keyword"
        out.append(Token(kind, text, line, column(m.start())))
        last = text if kind in ("keyword", "op") else "value"
        if kind == "string" and "\n" in text:
            line, start = line + text.count("\n"), m.start() + text.rindex("\n") + 1
    if out and last not in ("", ";"):
        close(len(source))
    out.append(Token("end", "", line, column(len(source))))
    return out


_BUILD = re.compile(r"^//go:build\s+(.*)$", re.M)
_SYSTEMS = frozenset("aix android darwin dragonfly freebsd illumos ios js linux netbsd openbsd plan9 solaris wasip1 windows".split())
_MACHINES = frozenset("386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x wasm".split())


def builds(path: str, source: str, tags: frozenset[str]) -> bool:
    """Whether a file belongs to the build: its name's system and machine, and its ``//go:build`` line."""
    known = tags | {"linux", "amd64", "unix", "gc"}
    parts = path.rsplit("/", 1)[-1].removesuffix(".go").removesuffix("_test").split("_")[1:]
    for p in parts[-2:]:
        if (p in _SYSTEMS or p in _MACHINES) and p not in known:
            return False
    head = re.split(r"(?m)^package\b", source, maxsplit=1)[0]
    m = _BUILD.search(head)
    if not m:
        return True
    words = re.findall(r"&&|\|\||!|\(|\)|[\w.]+", m[1])
    at = 0

    def either() -> bool:
        nonlocal at
        value = both()
        while at < len(words) and words[at] == "||":
            at += 1
            right = both()
            value = value or right
        return value

    def both() -> bool:
        nonlocal at
        value = single()
        while at < len(words) and words[at] == "&&":
            at += 1
            right = single()
            value = value and right
        return value

    def single() -> bool:
        nonlocal at
        word = words[at]
        at += 1
        if word == "!":
            return not single()
        if word == "(":
            value = either()
            at += 1
            return value
        return word in known or bool(re.fullmatch(r"go1\.\d+", word))

    return either()
