"""Modules of a tree: what its go.mod asks for, and the folders where those modules lie.

A go.mod is one small text; it is parsed on the driver.  Sources of modules are only listed here, they
are read by the front end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .source_tree import Root


@dataclass(frozen=True)
class Requirement:
    path: str
    version: str
    indirect: bool = False


@dataclass(frozen=True)
class Module:
    path: str
    requirements: tuple[Requirement, ...] = ()
    replaced: tuple[tuple[str, str, str, str], ...] = ()  # path, version or "", new path, new version or ""


def _directives(text: str):
    """(verb, words, comment) of each line; a block's verb stands for all of its lines."""
    block = ""
    for line in text.split("\n"):
        code, _, comment = line.partition("//")
        words = [w.strip('"`') for w in re.findall(r'"[^"]*"|`[^`]*`|[^\s()]+|[()]', code)]
        if not words:
            continue
        if block:
            if words == [")"]:
                block = ""
            else:
                yield block, words, comment.strip()
        elif words[1:] == ["("]:
            block = words[0]
        else:
            yield words[0], words[1:], comment.strip()


def parse(text: str) -> Module:
    """Module path, requirements and replacements of a go.mod.  Of a path required twice the last line holds."""
    path, asked, replaced = "", {}, []
    for verb, words, comment in _directives(text):
        if verb == "module" and words:
            path = words[0]
        elif verb == "require" and len(words) == 2:
            asked[words[0]] = Requirement(*words, re.match(r"indirect(\s|;|$)", comment) is not None)
        elif verb == "replace" and "=>" in words:
            at = words.index("=>")
            old, new = words[:at], words[at + 1 :]
            if old and new:
                replaced.append((old[0], (old[1:] or [""])[0], new[0], (new[1:] or [""])[0]))
    return Module(path, tuple(asked.values()), tuple(replaced))


def escaped(path: str) -> str:
    """A module path or version as the module cache spells it: a capital letter is ``!`` and its small form."""
    return re.sub(r"[A-Z]", lambda m: "!" + m[0].lower(), path)


def folder_of(asked: Requirement, module: Module, root: str, cache: str) -> list[str]:
    """Where the sources of a requirement may lie, most likely first: its replacement, the vendor folder, the cache."""
    base = root.rstrip("/")
    new = [(p, v) for old, of, p, v in module.replaced if old == asked.path and of in ("", asked.version)]
    path, version = new[-1] if new else (asked.path, asked.version)
    if path.startswith(("./", "../")):
        return [f"{base}/{path}"]
    if path.startswith("/"):
        return [path]
    out = [f"{base}/vendor/{asked.path}"]
    return out + [f"{cache.rstrip('/')}/{escaped(path)}@{escaped(version)}"] * bool(cache)


def roots(spark: SparkSession, folder: str, cache: str = "", std: str = "") -> tuple[list[Root], list[Requirement]]:
    """Roots of a tree, and the requirements whose sources are nowhere.

    The main module comes first, then direct and indirect requirements in the order of go.mod, then the
    standard library where ``std`` names its folder.  Without a go.mod the tree is a root without a path.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))

    base = folder.rstrip("/")
    module = Module("")
    if there(f"{base}/go.mod"):
        module = parse(spark.read.text(f"{base}/go.mod", wholetext=True).first().value)
    out, missing = [Root(base, module.path, main=True)], []
    for asked in sorted(module.requirements, key=lambda r: r.indirect):
        found = next((f for f in folder_of(asked, module, base, cache) if there(f)), None)
        if found is None:
            missing.append(asked)
        else:
            out.append(Root(found, asked.path, indirect=asked.indirect))
    return out + [Root(std)] * bool(std), missing
