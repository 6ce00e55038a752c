"""Connected components by local forests and contraction, in the cluster.

Each round first joins what meets inside a task: a task reads about ``LOCAL`` links and
leaves a tree's links to its least node for each tree it finds, so that a large component
keeps a link for each of its nodes. Where one task holds all that is left, that is the
answer. Else every node follows the least of itself and its neighbours in an order
that is drawn anew from a hash, and nodes are replaced by what they follow. Nodes
that follow another disappear, a constant share of all that still have links; so
rounds grow with the logarithm of the links over ``LOCAL``. Every round's tables are
written to the shared folder and deleted when the roots are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import discard, materialise

#: Links that a task joins.
LOCAL = 250_000


def _forest(links: DataFrame, loops: bool) -> DataFrame:
    """(node, to) of the trees that each task finds: every node to its tree's least, with ``loops`` that one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            at = x
            while (up := parent.setdefault(at, at)) != at:
                at = up
            while parent[x] != at:
                parent[x], x = at, parent[x]
            return at

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in parent]
        rows = [r for r in rows if loops or r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["node", "to"])

    return links.mapInArrow(run, "node long, to long")


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v; long): one root for each component.

    Null ends and loops are ignored; repeated and reversed edges do no harm; no edges give no rows.
    """
    now = materialise(edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")), "links")
    steps: list[DataFrame] = []
    while True:
        tasks = max(1, -(-now.count() // local))
        joined = materialise(_forest(now.coalesce(tasks), tasks == 1), "forest")
        discard(now)
        if tasks == 1:
            steps.append(joined)
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = joined.union(joined.select("to", "node")).toDF("node", "other")
        follow = both.groupBy("node").agg(F.min(rank("other")).alias("best"))
        follow = materialise(follow.select("node", F.least(rank("node"), F.col("best"))["id"].alias("to")), "follow")
        moved = joined.toDF("u", "v").join(follow.toDF("u", "a"), "u").join(follow.toDF("v", "b"), "v").where("a <> b")
        now = materialise(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        discard(joined)
        steps.append(follow)
    roots = steps[0].toDF("node", "root")
    for step in steps[1:]:
        roots = roots.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = materialise(roots, "roots")
    discard(*steps)
    return out
