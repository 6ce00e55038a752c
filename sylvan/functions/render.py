"""Text forms of results. Lines are made in the cluster, for a file's outline in a task of its file; the driver joins
the lines that it asked for. Call trees, of one name and a bounded depth, are drawn on the driver."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEE, END, BAR, GAP = "├── ", "└── ", "│   ", "    "


def matches(found: DataFrame, several: bool) -> str:
    """Lines of matches, with the file in front if several files were searched."""
    rows = found.orderBy("path", "ord").select("path", "rendered").toLocalIterator()
    return "".join(f"{r['path']}: {r['rendered']}\n" if several else f"{r['rendered']}\n" for r in rows)


def tree(children: dict[int, list[tuple[int, str]]], at: int = -1, prefix: str = "") -> Iterable[str]:
    """Lines of a tree given as children (number, text) of each number."""
    below = children.get(at, [])
    for i, (number, text) in enumerate(below):
        last = i == len(below) - 1
        yield f"{prefix}{END if last else TEE}{text}"
        yield from tree(children, number, prefix + (GAP if last else BAR))


def outline_texts(items: DataFrame) -> DataFrame:
    """path and the text of each file's outline."""

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        children: dict[int, list[tuple[int, str]]] = {}
        for r in frame.sort_values("item_id").itertuples():
            children.setdefault(r.parent_id, []).append((r.item_id, f"{r.kind} {r.name}  :{r.line}"))
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "text": ["".join(line + "\n" for line in tree(children))]})

    rows = items.select("path", "item_id", "parent_id", "kind", "name", "line").where("path is not null")
    return rows.groupBy("path").applyInPandas(draw, "path string, text string")


def outline(items: DataFrame) -> str:
    """Outlines of files, a blank line between them."""
    return "\n".join(r["text"] for r in outline_texts(items).orderBy("path").toLocalIterator())


def _base(path: str) -> str:
    return path.rpartition("/")[2]


def calltree(name: str, roots: DataFrame, walked: DataFrame) -> str:
    """Trees of callers or callees, one for each definition of the name."""
    starts = [(tuple(r["root"]), r["path"], r["line"]) for r in roots.orderBy("root").collect()]  # definitions of one name
    lines: dict[tuple | None, dict] = {}
    for r in walked.orderBy("root", "trail").toLocalIterator():
        root = tuple(r["root"]) if r["root"] is not None else None
        lines.setdefault(root, {})[tuple(map(tuple, r["trail"]))] = r
    out = []
    for root, path, line in starts or [(None, None, None)]:
        head = f"{name}()" + (f"  [{_base(path)}:{line}]" if len(starts) > 1 else "")
        children: dict[int, list[tuple[int, str]]] = {}
        numbers = {(): -1}
        for i, (trail, r) in enumerate(lines.get(root, {}).items()):
            numbers[trail] = i
            where = f"  [{_base(r['path'])}:{r['line']}]" if r["path"] is not None else ""
            text = f"{r['display']}(){where}{' ?' if r['is_guess'] else ''}{' (cycle)' if r['cycle'] else ''}"
            children.setdefault(numbers[trail[:-1]], []).append((i, text))
        out.append("".join(x + "\n" for x in [head, *tree(children)]))
    return "\n".join(out)


def edge_lines(edges: DataFrame) -> DataFrame:
    """The edges with a line of text each."""
    return edges.withColumn("text", F.concat("src_id", F.lit(" -> "), "dst_id", F.when(F.col("is_guess"), " ?").otherwise("")))


def edge_list(edges: DataFrame) -> str:
    rows = edge_lines(edges).orderBy("src_id", "dst_id", "src_label", "dst_label", "is_guess").toLocalIterator()
    return "".join(f"{r['text']}\n" for r in rows)


def _quote(text: str) -> Column:
    escaped = F.col(text)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def dot_lines(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the graph in DOT: its nodes (id, text), and its edges with a text each; guesses are dashed."""
    ends = edges.select(F.col("src_id").alias("id"), F.col("src_label").alias("label")).union(edges.select("dst_id", "dst_label"))
    nodes = ends.groupBy("id").agg(F.min("label").alias("label"))
    nodes = nodes.select("id", F.concat(F.lit("    "), _quote("id"), F.lit(" [label="), _quote("label"), F.lit("];")).alias("text"))
    style = F.when(F.col("is_guess"), " [style=dashed];").otherwise(";")
    return nodes, edges.withColumn("text", F.concat(F.lit("    "), _quote("src_id"), F.lit(" -> "), _quote("dst_id"), style))


def dot(edges: DataFrame) -> str:
    """The graph in DOT: nodes by id, then edges."""
    nodes, lines = dot_lines(edges)
    out = ["digraph callgraph {", *(r["text"] for r in nodes.orderBy("id").toLocalIterator()), ""]
    out += [r["text"] for r in lines.orderBy("src_id", "dst_id", "src_label", "dst_label", "is_guess").toLocalIterator()]
    return "\n".join([*out, "}"]) + "\n"


def definition_lines(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Definitions found, with a line of text each: their place and source line."""
    lines = files.select("path", F.posexplode(F.split("source", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("text", r"[\r\t]", " ")).alias("text"))
    text = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.coalesce("text", F.lit("")), F.when(F.col("is_guess"), "  ?").otherwise(""))
    return hits.join(lines, ["path", "line"], "left").select("path", "line", text.alias("text"))


def definitions(hits: DataFrame, files: DataFrame) -> str:
    """Definitions found, with their source lines."""
    return "".join(f"{r['text']}\n" for r in definition_lines(hits, files).orderBy("path", "line").toLocalIterator())
