"""Command line: ``python -m sylvan -q QUERY PATH...``, ``tree``, ``callers``, ``callees``, ``callgraph``, ``def``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sylvan.engine import Engine
from sylvan.functions.languages import LANGUAGES
from sylvan.operators.graph import DEPTH
from sylvan.operators.search import explain


def arguments(argv: list[str]) -> argparse.Namespace:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--lang", help="language of all files, whatever their extension")
    common.add_argument("--no-ignore", action="store_true", help="search ignored files, too")
    if argv[:1] and argv[0] in ("tree", "callers", "callees", "callgraph", "def"):
        p = argparse.ArgumentParser(prog=f"sylvan {argv[0]}", parents=[common])
        if argv[0] in ("callers", "callees", "def"):
            p.add_argument("name")
        p.add_argument("paths", nargs="+")
        if argv[0] in ("callers", "callees"):
            p.add_argument("--depth", type=int, default=DEPTH)
        if argv[0] == "callgraph":
            p.add_argument("--format", default="dot", help="dot or edges")
        out = p.parse_args(argv[1:])
        out.command = argv[0]
        return out
    p = argparse.ArgumentParser(prog="sylvan", parents=[common], description=__doc__)
    p.add_argument("-q", "--query", required=True)
    p.add_argument("paths", nargs="*")
    p.add_argument("--body", action="store_true", help="whole texts of matches")
    p.add_argument("--compat", action="store_true", help="older meanings of combinators")
    p.add_argument("--show-query", action="store_true", help="print the plan")
    out = p.parse_args(argv)
    out.command = "search"
    return out


def run(argv: list[str], spark: SparkSession | None = None) -> str:
    """The command's output; ValueError and OSError for what can't be done."""
    a = arguments(argv)
    out = ""
    if a.command == "search":
        if a.show_query or not a.paths:
            out = explain(a.query, (a.lang,) if a.lang else LANGUAGES, a.compat) + "\n"
        if not a.paths:
            return out
    engine = Engine.of(spark or SparkSession.builder.appName("sylvan").getOrCreate(), a.paths, a.lang, a.no_ignore)
    for path in (lost := engine.unreadable()):
        print(f"failed to read {path}", file=sys.stderr)
    if lost and a.command == "tree":
        raise OSError(f"{len(lost)} of the files can't be read")
    if a.command == "search":
        return out + engine.search_text(a.query, a.body, a.compat)
    if a.command == "tree":
        return engine.outline_text()
    if a.command == "callgraph":
        return engine.edges_text(a.format)
    if a.command == "def":
        text = engine.definition_text(a.name)
        if not text:
            raise ValueError(f"no definition found for {a.name!r}")
        return text
    return engine.callers_text(a.name, a.depth) if a.command == "callers" else engine.callees_text(a.name, a.depth)


def main() -> int:
    try:
        sys.stdout.write(run(sys.argv[1:]))
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
