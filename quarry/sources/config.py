"""Repository configuration: a YAML file, validated into plain data classes."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from .. import model
from ..operators.citations import Pattern
from ..operators.symbols import active_tiers


@dataclass(frozen=True)
class Resource:
    path: str
    title: str = ""
    description: str = ""


@dataclass(frozen=True)
class Config:
    version: int = 1
    direct: bool | None = None  # None: on
    indirect: bool | None = None
    stdlib: bool | None = None
    resources: tuple[Resource, ...] = ()
    citations: tuple[Pattern, ...] = ()
    lint: tuple[tuple[str, dict], ...] = ()
    proto_packages: tuple[str, ...] = ()
    entry_points: dict[str, list[str]] = field(default_factory=dict)

    @property
    def tiers(self) -> tuple[int, ...]:
        return active_tiers(self.direct, self.indirect, self.stdlib)


#: Dependency presets (direct, indirect, stdlib).
PRESETS = {"workspace": (False, False, False), "direct": (True, False, False), "all": (True, True, True), "stdlib": (True, False, True)}


def with_preset(config: Config, preset: str) -> Config:
    if not preset:
        return config
    if preset not in PRESETS:
        raise model.QueryError(f"unknown preset {preset!r}: use {', '.join(PRESETS)}")
    from dataclasses import replace

    direct, indirect, stdlib = PRESETS[preset]
    return replace(config, direct=direct, indirect=indirect, stdlib=stdlib)


def resolve_root(flag: str = "", environ: dict[str, str] | None = None, cwd: str = ".") -> str:
    """The tree's folder: the flag, else QUARRY_ROOT, else the working folder; it must hold a go.mod."""
    import os

    chosen = flag or (os.environ if environ is None else environ).get("QUARRY_ROOT") or cwd
    root = Path(chosen).resolve()
    if not (root / "go.mod").is_file():
        raise model.QueryError(f"{root} has no go.mod")
    return str(root)


def load(path: str) -> Config:
    """Configuration of a file; one that doesn't exist is the empty configuration."""
    if not Path(path).exists():
        return Config()
    return parse(_yaml(Path(path).read_text()))


def parse(raw: dict | None) -> Config:
    raw = raw or {}
    if not isinstance(raw, dict):
        raise model.QueryError("the configuration must be a mapping")
    index = raw.get("dep_index") or {}
    return Config(
        version=raw.get("version") or 1,
        direct=index.get("direct"), indirect=index.get("indirect"), stdlib=index.get("stdlib"),
        resources=tuple(Resource(r["path"], r.get("title", ""), r.get("description", "")) for r in raw.get("resources") or []),
        citations=tuple(Pattern(c["pattern"], c.get("vendor_root", ""), c.get("description", "")) for c in raw.get("citations") or []),
        lint=tuple((e["import"], e.get("config") or {}) for e in raw.get("lint") or []),
        proto_packages=tuple(e["import"] for e in raw.get("proto") or []),
        entry_points={k: list(v) for k, v in (raw.get("entry_points") or {}).items()},
    )


def _yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise model.QueryError("reading YAML needs the yaml package; pass a parsed mapping to parse() instead") from e
    return yaml.safe_load(text) or {}
