"""Approximate nearest neighbours by stable projections (operator 9).

Vectors are projected on ``M`` directions of standard normal components (the normal
distribution is 2-stable: the squared projected distance of two points over their
squared distance is chi-square with M degrees of freedom). A kd-tree over the
projections gives projected neighbours nearest first; each is verified by its true
distance. The search stops when the next projected distance l and the k-th best true
distance d satisfy chi2_M(l^2 / d^2) >= ``SURE``: a point nearer than d would have
been met before with at least that probability. Expected recall is thus at least
``SURE``; every row is indexed. d is also held by the k-th distance among the seed rows that all queries meet
first (see :mod:`sylvan.llm.blocks`). Shards are merged by a top-k for each query.

Vectors that are null, zero, or hold null or non-finite components take no part. Every row of another vec_id is a
candidate, also those that repeat a vec_id or a vector; ties go to the smaller vec_id. Equal queries count once,
different vectors of one vec_id share its ranks. Vectors of different lengths don't meet; long ones make shards of
fewer rows. An empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.blocks import Found, Stack, search, vectors

K = 10
EVERY = 100
#: Projections; even, so that the chi-square distribution has a closed form.
M = 8
SURE = 0.97
LEAF = 64
SEED = 9


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


class KdTree:
    """Boxes of projected points: children of each node, or a leaf's members."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.low, self.high, self.below = [], [], []
        self.points, self.leaf = points, leaf
        self.grow(np.arange(len(points)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def grow(self, members: np.ndarray) -> int:
        p = self.points[members]
        node = len(self.below)
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.below.append(members)
        if len(members) > self.leaf:
            axis = int(np.argmax(self.high[node] - self.low[node]))
            half = len(members) // 2
            order = np.argpartition(p[:, axis], half)
            self.below[node] = (self.grow(members[order[:half]]), self.grow(members[order[half:]]))
        return node

    def bounds(self, q: np.ndarray) -> list[float]:
        """Squared distance of the query to each box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap).tolist()

    def nearest_first(self, q: np.ndarray):
        """(squared lower bound, members) of leaves, in the order of the bound."""
        bound = self.bounds(q)
        heap = [(bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if isinstance(self.below[node], tuple):
                for child in self.below[node]:
                    heapq.heappush(heap, (bound[child], child))
            else:
                yield b, self.below[node]


def one_query(tree: KdTree, ids: np.ndarray, d: np.ndarray, q: np.ndarray, projected: np.ndarray, own: int, k: int, stop: float, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest found. ``bound``: a distance that k rows elsewhere are known to have."""
    found_d, found_i, kth = np.empty(0), np.empty(0, np.int64), math.inf
    for gap, members in tree.nearest_first(projected):
        if len(found_d) == k and gap > stop * min(kth, bound * bound):
            break
        diff = d[members] - q
        dist, who = (diff * diff).sum(axis=1), ids[members]
        keep = (dist <= kth) & (who != own)
        if not keep.any():
            continue
        found_d, found_i = np.append(found_d, dist[keep]), np.append(found_i, who[keep])
        order = np.lexsort((found_i, found_d))[:k]
        found_d, found_i = found_d[order], found_i[order]
        if len(found_d) == k:
            kth = float(found_d[-1])
    return np.sqrt(found_d), found_i


def shard(k: int, m: int = M, sure: float = SURE, leaf: int = LEAF) -> Callable[[Stack], Callable[[int, np.ndarray, np.ndarray, np.ndarray], Found]]:
    """Index of a shard: a kd-tree over the projections for each number of dimensions."""
    stop = quantile(sure, m)

    def index(stack: Stack) -> Callable[[int, np.ndarray, np.ndarray, np.ndarray], Found]:
        trees = {n: (KdTree(d @ directions(n, m), leaf), ids, d) for n, (ids, d) in stack.items() if n}

        def look(n: int, own: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Found:
            owners, ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if n in trees:
                tree, cid, d = trees[n]
                for name, row, projected, limit in zip(own.tolist(), q, q @ directions(n, m), bound.tolist(), strict=True):
                    s, i = one_query(tree, cid, d, row, projected, name, k, stop, math.inf if math.isnan(limit) else limit)
                    owners.append(np.full(len(i), name))
                    ids.append(i)
                    scores.append(s)
            return np.concatenate(owners), np.concatenate(ids), np.concatenate(scores)

        return look

    return index


def directions(n: int, m: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, m))


def bounds(k: int) -> Callable[[Stack], Callable[[int, np.ndarray, np.ndarray], np.ndarray]]:
    """The queries' k-th least distances among the seeds, a little enlarged for rounding."""

    def bound(stack: Stack) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        def look(n: int, own: np.ndarray, q: np.ndarray) -> np.ndarray:
            ids, d = stack.get(n, (np.empty(0, np.int64), np.empty((0, n))))
            if len(ids) < k:
                return np.full(len(q), np.nan)
            square = (q * q).sum(axis=1)[:, None] + (d * d).sum(axis=1)[None, :] - 2 * q @ d.T
            square[ids[None, :] == own[:, None]] = np.inf
            out = np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0)) * (1 + 1e-6)
            return np.where(np.isfinite(out), out, np.nan)

        return look

    return bound


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): for each row whose vec_id ``every`` divides."""
    rows = vectors(embeddings).where(F.exists("v", lambda x: x != 0))
    return search(rows, every, shard(k), bounds(k), "double", k, False, **sizes)
