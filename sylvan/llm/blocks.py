"""A stated query set against all rows, shard by shard.

Rows are dealt once, by a hash, into shards of at most about ``CELLS`` numbers, one to a task. A shard's rows come
first in its task and are indexed once; then the queries stream past, a batch at a time, so a task's memory is bounded
by the shard and a batch. Rows are sent once and queries once for each shard, which is what their work grows with
anyway. Each query brings a bound along: its k-th best score among ``SEEDS`` rows that are the same for all (those of
the least hash); no shard looks for what is worse. What the shards find is merged by a top-k for each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.runtime import release, ship

#: Numbers in a shard's vectors.
CELLS = 4_194_304
#: Rows that every query meets first.
SEEDS = 4_096
#: Queries that are worked on together.
BATCH = 256

#: Ids and a matrix for each number of dimensions: vectors of different lengths don't meet.
Stack = dict[int, tuple[np.ndarray, np.ndarray]]
#: (owners, ids, scores) of what is found.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part: neither null nor holding null or
    non-finite components, and with a vec_id."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def stacked(ids: pa.Array, v: pa.ListArray) -> Stack:
    """Vectors by their number of dimensions, in the order given."""
    lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist():
        mask = pa.array(lengths == n)
        part = v.filter(mask)
        out[n] = (ids.filter(mask).to_numpy(zero_copy_only=False).astype(np.int64), part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), n))
    return out


def joined(stacks: list[Stack]) -> Stack:
    """One stack of all rows, ids ascending."""
    out = {}
    for n in sorted({n for s in stacks for n in s}):
        ids = np.concatenate([s[n][0] for s in stacks if n in s])
        d = np.concatenate([s[n][1] for s in stacks if n in s])
        order = np.argsort(ids, kind="stable")
        out[n] = (ids[order], d[order])
    return out


def search(rows: DataFrame, every: int, index: Callable[[Stack], Callable[[int, np.ndarray, np.ndarray, np.ndarray], Found]], bound: Callable[[Stack], Callable[[int, np.ndarray, np.ndarray], np.ndarray]], score: str, k: int, descending: bool, cells: int = CELLS, seeds: int = SEEDS, batch: int = BATCH) -> DataFrame:
    """Top ``k`` for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Candidates are all rows of another vec_id, each row of a repeated one. Queries are the distinct (vec_id, vector);
    those of one vec_id share its ranks. ``index(stack)`` gives a function of (dimensions, query ids, queries, bounds) to
    the best k of the shard for each query, as far as they reach its bound; ``bound(stack)`` one of (dimensions, query
    ids, queries) to their k-th best scores among the stack's rows, nan where there are fewer.
    """
    spark = ship(rows.sparkSession)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, shard = size["n"], max(1, cells // max(size["dims"] or 1, 1))
    shards = max(1, -(-n // shard), min(16, n // 256))  # a few more for small tables, that all cores have work
    first = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(seeds).collect()  # bounded by the parameter
    seed = joined([stacked(pa.array([r["vec_id"] for r in first], pa.int64()), pa.array([r["v"] for r in first], pa.list_(pa.float64())))] if first else [])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = bound(seed)
        for b in batches:
            for dims, (ids, q) in stacked(b.column(0), b.column(1)).items():
                for at in range(0, len(ids), batch):
                    own, part = ids[at : at + batch], q[at : at + batch]
                    v = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dims, pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(own), v, pa.array(look(dims, own, part), pa.float64())], names=["vec_id", "v", "bound"])

    queries = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(bounded, "vec_id long, v array<double>, bound double")
    deal = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    left = rows.select(deal.alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", "bound")
    dealt = left.union(right).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Stack] = []
        look = None
        for b in batches:
            kind = b.column(1)
            mine = b.filter(pc.equal(kind, 0))
            if len(mine):
                held.append(stacked(mine.column(2), mine.column(3)))
            asked = b.filter(pc.equal(kind, 1))
            if not len(asked):
                continue
            if look is None:
                look = index(joined(held))
                held = []
            bounds = asked.column(4).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(asked.column(3)).to_numpy(zero_copy_only=False)
            for dims, (ids, q) in stacked(asked.column(2), asked.column(3)).items():
                own = bounds[lengths == dims]
                for at in range(0, len(ids), batch):
                    found = look(dims, ids[at : at + batch], q[at : at + batch], own[at : at + batch])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])
        release()

    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
