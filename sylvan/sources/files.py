"""Source files: discovery, languages, and the tables that parsing gives.

Discovery walks directories in the driver with ignore rules and gives a sorted list of
paths; contents are read by executors. A table of sources (path, lang, source) of any
other origin serves as well, for instance a Parquet table of a whole archive.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.languages import canonical, detect, extensions
from sylvan.runtime import ship
from sylvan.sources.facts import COLUMNS, facts

NODES = "path string, lang string, node_id int, last_desc int, parent_id int, depth int, kind string, field string, named_idx int, start_pos int, end_pos int, start_line int, end_line int, text string, first_line string"
FACTS = "path string, lang string, " + ", ".join(f"{n} {t}" for n, t in COLUMNS)
INVALID = "<invalid utf8>"
#: First lines of nodes up to this length are kept in the table of nodes.
LONG_LINE = 400


class AccessError(OSError):
    """A path that can't be read."""


class Ignore:
    """Rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, lines: list[str]):
        self.folder = folder
        self.rules = [r for r in map(self.rule, lines) if r is not None]

    @staticmethod
    def rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
        """(pattern over the relative path, negated, folders only)."""
        line = line.rstrip("\r\n")
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\")
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out = ""
        for piece in re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]*\])", line.lstrip("/")):
            if piece == "**/":
                out += "(?:.*/)?"
            elif piece == "/**":
                out += "/.*"
            elif piece == "*":
                out += "[^/]*"
            elif piece == "?":
                out += "[^/]"
            elif piece.startswith("[") and piece.endswith("]"):
                out += piece.replace("[!", "[^")
            else:
                out += re.escape(piece)
        return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        relative = os.path.relpath(path, self.folder)
        out = None
        for pattern, negated, folders in self.rules:
            if (is_folder or not folders) and pattern.match(relative):
                out = not negated
        return out


def _read_rules(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().split("\n")
    except OSError:
        return []


def _outer_rules(top: str) -> list[Ignore]:
    """Rules from folders above, the repository's exclude file and the user's global file."""
    out = [Ignore(top, _read_rules(os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")))]
    chain, at = [], os.path.abspath(top)
    while True:
        chain.append(at)
        if os.path.isdir(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            break
        at = os.path.dirname(at)
    for folder in reversed(chain[1:]):
        names = (".gitignore", ".ignore") if os.path.isdir(os.path.join(chain[-1], ".git")) else (".ignore",)
        out += [Ignore(folder, _read_rules(os.path.join(folder, n))) for n in names]
    out.append(Ignore(chain[-1], _read_rules(os.path.join(chain[-1], ".git", "info", "exclude"))))
    return out


def walk(top: str, wanted: frozenset[str], no_ignore: bool = False) -> list[str]:
    """Files below a folder with one of the extensions, sorted; hidden ones included."""
    out: list[str] = []

    def into(folder: str, rules: list[Ignore]) -> None:
        if not no_ignore:
            rules = [*rules, *(Ignore(folder, _read_rules(os.path.join(folder, n))) for n in (".gitignore", ".ignore"))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            is_folder = e.is_dir(follow_symlinks=False)
            if is_folder and e.name == ".git":
                continue
            verdict = next((v for r in reversed(rules) if (v := r.verdict(os.path.abspath(e.path), is_folder)) is not None), False)
            if verdict:
                continue
            if is_folder:
                into(e.path, rules)
            elif e.is_file() and e.name.rpartition(".")[2] in wanted and "." in e.name[1:]:
                out.append(e.path)

    into(top, [] if no_ignore else [Ignore(os.path.abspath(r.folder), []) if not r.rules else r for r in _outer_rules(top)])
    return sorted(out)


def jobs(paths: str | list[str], lang: str | None = None, no_ignore: bool = False) -> list[tuple[str, str]]:
    """(path, language) of files, and of files below folders. AccessError for a path that isn't there;
    ValueError for an unknown language, or one that a file's extension doesn't tell."""
    lang = canonical(lang) if lang is not None else None
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(path):
            out += [(f, lang or detect(f)) for f in walk(path, extensions(lang), no_ignore)]
        elif os.path.exists(path):
            found = lang or detect(path)
            if found is None:
                raise ValueError(f"can't tell the language of {path}; name it")
            out.append((path, found))
        else:
            raise AccessError(f"failed to access {path}")
    return out


def read(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    """path, lang, source of files that executors read. Files that can't be read have a null source,
    bytes that are no UTF-8 become U+FFFD."""
    ship(spark)
    table = spark.createDataFrame(found, "path string, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for p in batch.column(0).to_pylist():
                try:
                    with open(p, "rb") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["path", "lang", "source"])

    return table.mapInArrow(run, "path string, lang string, source string")


def scan(spark: SparkSession, folder: str, lang: str | None = None) -> DataFrame:
    """path, lang, source below a folder of any file system that Spark reads, by its binary reader.
    Names that begin with a dot or an underscore are left out, as that reader does."""
    lang = canonical(lang) if lang is not None else None
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    table = F.create_map(*[x for e in sorted(extensions(lang)) for x in (F.lit(e), F.lit(lang or detect("x." + e)))])
    return found.where(ext.isin(*sorted(extensions(lang)))).select("path", F.element_at(table, ext).alias("lang"), F.decode("content", "UTF-8").alias("source"))


def _parsed(batches: Iterator[pa.RecordBatch]):
    from sylvan.sources.cst import parse

    for batch in batches:
        for path, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if path is not None and source is not None and lang is not None:
                yield path, lang, source, parse(source, lang)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for r in rows:
        kept.append(r)
        if len(kept) >= size:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


def nodes(files: DataFrame) -> DataFrame:
    """The table of syntax nodes of files (path, lang, source)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sylvan.sources.cst import rows

        def each() -> Iterator[tuple]:
            for path, lang, source, root in _parsed(batches):
                invalid = "�" in source
                for r in rows(root, source):
                    text = r[11]
                    if text is not None and r[9] == r[10]:  # within a line
                        first = text.removesuffix("\r")
                    else:
                        start, end = r[7], r[8]
                        stop = source.find("\n", start, end)
                        first = source[start : end if stop < 0 else stop].removesuffix("\r")
                    if invalid and ("�" in first or text is not None and "�" in text):
                        yield (path, lang, *r[:11], INVALID, INVALID)
                    else:
                        yield (path, lang, *r, first if len(first) <= LONG_LINE else None)

        yield from _batched(each(), _arrow(NODES))

    return files.select("path", "lang", "source").mapInArrow(run, NODES)


def relations(files: DataFrame) -> DataFrame:
    """The rows of :mod:`sylvan.sources.facts` of files (path, lang, source): parsed once, for all relations."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for path, lang, source, root in _parsed(batches):
                for r in facts(root, source, path, lang):
                    yield (path, lang, *(r.get(n) for n, _ in COLUMNS))

        yield from _batched(each(), _arrow(FACTS))

    return files.select("path", "lang", "source").mapInArrow(run, FACTS)
