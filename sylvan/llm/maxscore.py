"""Exact top-k by integer inner product with MaxScore (operator 2).

Dimensions are query terms; a shard's column of a dimension is that term's posting
list. In a shard a term contributes between lo and hi, its least and greatest
product with the query's weight. Terms are taken in the order of hi - lo, added up over a batch of queries. They split
where a document that gets no more than lo from all terms before could not reach the
threshold even with hi from all that follow, for any query of the batch: the terms before are essential, and their
postings are traversed for the whole shard, a block of documents at a time for all queries of the batch. So are those
that follow while most documents are still competitive, which costs less than to probe them. The
others are probed, a few at a time, only for pairs of query and document whose score so far plus the hi
of what is left still reaches the query's threshold. The threshold is the k-th best score that the query has met so
far: among the seed rows that all queries meet first, among the shard's first documents, and in the blocks done.
Reaching it is enough to stay, so ties are never lost. Shards are merged by a top-k for each query.

Vectors that are null or hold null or non-finite components take no part. Scores
beyond a long are held at its ends. Every row of another vec_id is a candidate, also those that repeat a vec_id or a
vector; equal queries count once, different vectors of one vec_id share its ranks. Vectors of different lengths
don't meet; long ones make shards of fewer rows. An empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from sylvan.llm.blocks import Found, Stack, search, vectors

K = 20
EVERY = 20
SCALE = 64
#: Documents that are scored whole at first, for a threshold.
WARM = 256
#: Documents of a block, and terms that are probed at a time.
BLOCK, PROBE = 16_384, 8
#: Share of the documents that are competitive still, up to which the other terms are probed document by document.
FEW = 1 / 16


def exact_type(d: np.ndarray, q: np.ndarray) -> type:
    """The smallest type in which every sum of products is exact."""
    bound = float(np.abs(d).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d.shape[1], 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def scaled(x: np.ndarray) -> np.ndarray:
    """The components as whole numbers."""
    return np.clip(np.floor(SCALE * x), -(2.0**63), 2.0**63)


def best(owners: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> Found:
    """Of each owner's rows the k best, ties to smaller ids."""
    order = np.lexsort((ids, -scores, owners))
    owners, ids, scores = owners[order], ids[order], scores[order]
    place = np.arange(len(owners)) - np.searchsorted(owners, owners)
    keep = place < k
    return owners[keep], ids[keep], scores[keep]


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, -inf where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64)


def one_batch(post: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, block: int = BLOCK) -> Found:
    """Places of queries, ids and scores of a shard's k best for each. ``post``: a row of postings for each term;
    ``floor``: what the queries have to reach."""
    a, b = q * low, q * high
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(-(hi - lo).sum(axis=0, dtype=np.float64), kind="stable")
    post, lo, hi, w = post[order], lo[:, order].astype(np.float64), hi[:, order].astype(np.float64), q[:, order]
    zero = np.zeros((len(q), 1))
    # what the terms from place p on can add, and what those before add at least
    rest, least = np.hstack([np.cumsum(hi[:, ::-1], axis=1)[:, ::-1], zero]), np.hstack([zero, np.cumsum(lo, axis=1)])
    warm = (w @ post[:, :WARM]).astype(np.float64)
    warm[ids[None, :WARM] == own[:, None]] = -np.inf
    floor = np.fmax(floor, kth(warm, k))
    found: Found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for at in range(0, len(ids), block):
        out = least + rest < floor[:, None]
        essential = int(np.where(out.any(axis=1), out.argmax(axis=1), len(order)).max(initial=0))
        part, names = post[:, at : at + block], ids[at : at + block]
        score = w[:, :essential] @ part[:essential]
        while True:
            # rounded down, so that none is lost where the type is narrow
            least_score = np.nextafter((floor - rest[:, essential]).astype(post.dtype), post.dtype.type(-np.inf))[:, None]
            if essential == len(order) or (score[:, :WARM] >= least_score).mean() <= FEW:
                break
            step = slice(essential, essential + PROBE)  # most documents are competitive still: one more step for all
            score += w[:, step] @ part[step]
            essential = min(essential + PROBE, len(order))
        i, j = np.nonzero(score >= least_score)
        other = names[j] != own[i]
        i, j = i[other], j[other]
        score = score[i, j].astype(np.float64)
        for p in range(essential, len(order), PROBE):
            score = score + (w[i, p : p + PROBE] * part[p : p + PROBE, j].T).sum(axis=1)
            done = min(p + PROBE, len(order))
            stay = score + rest[i, done] >= floor[i]
            i, j, score = i[stay], j[stay], score[stay]
        found = best(np.append(found[0], i), np.append(found[1], names[j]), np.append(found[2], score), k)
        full = np.bincount(found[0], minlength=len(q)) >= k
        last = np.searchsorted(found[0], np.arange(len(q)), side="right") - 1
        floor = np.where(full, np.fmax(floor, found[2][last] if len(found[2]) else -np.inf), floor)
    return found


def in_full(cid: np.ndarray, d: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> Found:
    """The same for numbers that no machine type holds, query by query."""
    whole = np.array([[int(x) for x in r] for r in d.tolist()], object).reshape(d.shape)
    owners, ids, scores = [], [], []
    for name, row in zip(own.tolist(), q.tolist(), strict=True):
        s = [min(max(sum(int(x) * y for x, y in zip(row, r, strict=True)), -(2**63)), 2**63 - 1) for r in whole]
        top = sorted((-x, c) for x, c in zip(s, cid.tolist(), strict=True) if c != name)[:k]
        owners += [name] * len(top)
        ids += [c for _, c in top]
        scores += [-x for x, _ in top]
    return np.array(owners, np.int64), np.array(ids, np.int64), np.array(scores, np.int64)


def shard(k: int) -> Callable[[Stack], Callable[[int, np.ndarray, np.ndarray, np.ndarray], Found]]:
    """Index of a shard: the postings of each number of dimensions."""

    def index(stack: Stack) -> Callable[[int, np.ndarray, np.ndarray, np.ndarray], Found]:
        whole = {n: (ids, scaled(d)) for n, (ids, d) in stack.items()}
        posts: dict = {}

        def look(n: int, own: np.ndarray, q: np.ndarray, floor: np.ndarray) -> Found:
            if n not in whole:
                return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            (ids, d), q = whole[n], scaled(q)
            kind = exact_type(d, q)
            if kind is object:
                return in_full(ids, d, own, q, k)
            if (n, kind) not in posts:
                post = np.ascontiguousarray(d.T.astype(kind))
                posts[n, kind] = post, post.min(axis=1), post.max(axis=1)
            at, found, scores = one_batch(posts[n, kind][0], ids, *posts[n, kind][1:], own, q.astype(kind), np.where(np.isnan(floor), -np.inf, floor), k)
            return own[at], found, scores.astype(np.int64)

        return look

    return index


def bounds(k: int) -> Callable[[Stack], Callable[[int, np.ndarray, np.ndarray], np.ndarray]]:
    """The queries' k-th best scores among the seeds."""

    def bound(stack: Stack) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        whole = {n: (ids, scaled(d)) for n, (ids, d) in stack.items()}

        def look(n: int, own: np.ndarray, q: np.ndarray) -> np.ndarray:
            q = scaled(q)
            if n not in whole or exact_type(whole[n][1], q) is object:
                return np.full(len(q), np.nan)
            ids, d = whole[n]
            score = q @ d.T
            score[ids[None, :] == own[:, None]] = -np.inf
            out = kth(score, k)
            return np.where(np.isinf(out), np.nan, out)

        return look

    return bound


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, its k best among all other rows."""
    return search(vectors(embeddings), every, shard(k), bounds(k), "long", k, True, **sizes)
