"""Lint: a registry of analyzers, each a function from facts to diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import globs

Run = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Analyzer:
    """name and a function from facts to file, line, col, message, category (and pkg_path, for globs)."""

    name: str
    run: Run


Factory = Callable[[dict], Analyzer | None]
_registry: dict[str, Factory] = {}


def register(key: str, factory: Factory | None = None):
    """Register a factory (also as a decorator); a key that is taken is an error."""
    if factory is None:
        return lambda f: register(key, f) or f
    if not key or key in _registry:
        raise ValueError(f"analyzer key {key!r} is empty or taken")
    _registry[key] = factory
    return None


def get(key: str) -> Factory | None:
    return _registry.get(key)


def keys() -> list[str]:
    return sorted(_registry)


def unregister(key: str) -> None:
    _registry.pop(key, None)


def build(entries: list[tuple[str, dict]]) -> list[Analyzer]:
    """Analyzers of configured (key, config) entries; a factory may decline with None."""
    out = []
    for key, config in entries:
        factory = get(key)
        if factory is None:
            raise model.QueryError(f"unknown analyzer {key!r}; known: {', '.join(keys()) or 'none'}")
        made = factory(config)
        if made is not None:
            out.append(made)
    return out


def run(facts: dict[str, DataFrame], analyzers: list[Analyzer], only: list[str] | None = None, package_glob: str = "") -> DataFrame:
    """Diagnostics of all analyzers (or those named), without repeats, severity ``error``."""
    parts = []
    for a in analyzers:
        if only and a.name not in only:
            continue
        found = a.run(facts).where(globs.package_glob(F.col("pkg_path"), package_glob))
        parts.append(found.select(F.lit(a.name).alias("analyzer"), F.lit("error").alias("severity"), "file", "line", "col", "message", "category"))
    if not parts:
        return model.empty(next(iter(facts.values())).sparkSession, "diagnostics")
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def strings(config: dict, key: str) -> list[str]:
    """A list of strings of a config, or an error that says what is wrong."""
    value = config.get(key)
    if value is None:
        return []
    if not isinstance(value, list):
        raise model.QueryError(f"{key} must be a list of strings")
    for k, item in enumerate(value):
        if not isinstance(item, str):
            raise model.QueryError(f"{key}[{k}] must be a string")
    return value


def banned_calls(nodes: DataFrame, banned: list[str], scopes: list[str]) -> DataFrame:
    """Calls in packages of ``scopes`` (empty: all) whose callee matches a pattern; one diagnostic a call."""
    calls = nodes.where((F.col("kind") == "call") & F.col("callee_qname").isNotNull())
    inside = F.lit(not scopes)
    for s in scopes:
        inside = inside | globs.package_glob(F.col("pkg_path"), s)
    hit = F.lit(False)
    for p in banned:
        hit = hit | globs.name_glob(F.col("callee_qname"), p)
    message = F.concat(F.lit("call to banned "), F.col("callee_qname"), F.lit(" in scope "), F.col("pkg_path"))
    return calls.where(inside).where(hit).select("pkg_path", "file", "line", "col", message.alias("message"), F.lit("bannedinscope").alias("category"))


@register("bannedinscope")
def _banned(config: dict) -> Analyzer:
    unknown = sorted(set(config) - {"banned", "scope", "scope_packages"})
    if unknown:
        raise model.QueryError(f"bannedinscope: unknown key {unknown[0]!r}; known: banned, scope_packages (or scope)")
    banned, scopes = strings(config, "banned"), strings(config, "scope_packages") + strings(config, "scope")
    if not banned:
        raise model.QueryError("bannedinscope: banned must name at least one call")
    return Analyzer("bannedinscope", lambda facts: banned_calls(facts["ast_nodes"], banned, scopes))
