"""``python -m quarry``: load a Go tree and serve its tools on standard input and output.

Messages of the server go to standard output, everything else to standard error.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from . import model
from .serve import Server
from .sources import config as C
from .sources import modules
from .sources.source_tree import source_facts
from .tools import Tools


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quarry", description="code navigation over a Go tree, as JSON-RPC on standard input and output")
    p.add_argument("--root", default="", help="the tree's folder (default: $QUARRY_ROOT, then the working folder)")
    p.add_argument("--config", default="", help="configuration file (default: .quarry.yaml in the root)")
    p.add_argument("--deps", default="", help=f"dependencies to index: {', '.join(C.PRESETS)}; overrides the configuration")
    p.add_argument("--tags", default="", help="build tags, by commas")
    p.add_argument("--cache", default="", help="module cache with the sources of required modules")
    p.add_argument("--std", default="", help="folder of the standard library's sources")
    return p.parse_args(given)


def load(spark: SparkSession, asked: argparse.Namespace) -> Tools:
    """The tools over the tree that the arguments name."""
    root = C.resolve_root(asked.root)
    config = C.with_preset(C.load(asked.config or f"{root}/.quarry.yaml"), asked.deps)
    roots, missing = modules.roots(spark, root, asked.cache, asked.std)
    for r in missing:
        print(f"quarry: no sources of {r.path} {r.version}", file=sys.stderr)
    tags = [t.strip() for t in asked.tags.split(",") if t.strip()]
    began = time.monotonic()
    tools = Tools(spark, source_facts(spark, roots, tags, config.tiers), config, root)
    print(f"quarry: {root} in {time.monotonic() - began:.1f} s; {tools.tier_breakdown().text}; {tools.load_faults(0).extra['count']} load error(s)", file=sys.stderr)
    return tools


def main(given: list[str] | None = None) -> int:
    asked = arguments(given)
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        tools = load(spark, asked)
    except model.QueryError as e:
        print(f"quarry: {e}", file=sys.stderr)
        return 2
    server = Server(lambda: tools)
    for line in server.run(sys.stdin):
        print(line, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
