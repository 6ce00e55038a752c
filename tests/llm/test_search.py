import math
import random

import numpy as np
import pytest

from sylvan.llm import ann, maxscore


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def vectors(n, dims=16, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims))
    x = centres[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, dims))
    return [(i, np.float32(v).tolist(), None) for i, v in enumerate(x)]


ODD = [(None, [1.0] * 16, ""), (5000, None, ""), (5020, [float("nan")] + [1.0] * 15, ""), (5040, [float("inf")] * 16, ""), (5060, [None] + [1.0] * 15, ""), (5080, [0.0] * 16, ""), (5100, [1.0, 2.0], ""), (5101, [1.5, -2.0], ""), (5200, [], ""), (7, None, "")]


def usable(rows, zero):
    return [(i, v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute_top(rows, k=20, every=20):
    ints = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in usable(rows, True)]
    out = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        mine = {tuple(v) for i, v in usable(rows, True) if i == q}
        scored = [(-sum(math.floor(64 * a) * b for a, b in zip(v, c, strict=True)), i) for v in mine for i, c in ints if i != q and len(c) == len(v)]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"cells": 1600, "batch": 7, "seeds": 50}, {"seeds": 0}])
def test_maxscore_is_exact(spark, sizes):
    rows = vectors(900) + ODD + [(3000 + i, vectors(900)[40][1], "") for i in range(60)] + [vectors(900)[20]]
    got = sorted(tuple(r) for r in maxscore.top_k(table(spark, rows), **sizes).collect())
    assert got == brute_top(rows)


def test_maxscore_prunes_but_never_a_tie():
    rng = np.random.default_rng(1)
    for trial in range(30):
        n, dims = 600, 24
        d = rng.integers(-5, 6, (n, dims)).astype(np.float32) * (rng.random(dims) ** 4 * 20).astype(int)
        q = rng.integers(-5, 6, (7, dims)).astype(np.float32)
        post, ids, own = np.ascontiguousarray(d.T.astype(np.float32)), np.arange(n), np.arange(trial, trial + 7)
        at, i, s = maxscore.one_batch(post, ids, post.min(axis=1), post.max(axis=1), own, q, np.full(7, -np.inf), 10, 100)
        for x in range(7):
            want = sorted((-y, j) for j, y in enumerate((d @ q[x]).tolist()) if j != own[x])[:10]
            assert [(-a, b) for a, b in zip(s[at == x].tolist(), i[at == x].tolist(), strict=True)] == want


def test_huge_components_keep_to_a_long(spark):
    rows = [(0, [3e38, 1.0], ""), (1, [3e38, -1.0], ""), (2, [-3e38, 1.0], "")]
    assert [tuple(r)[1:] for r in maxscore.top_k(table(spark, rows)).sort("rank").collect()] == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]


def recall(spark, rows, **sizes):
    all_ = usable(rows, False)
    got = {}
    for r in ann.nearest(table(spark, rows), **sizes).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    hits = total = 0
    for q, v in {i: v for i, v in all_ if i % 100 == 0}.items():
        scored = sorted((math.dist(v, c), i) for i, c in all_ if i != q and len(c) == len(v))[:10]
        mine = [got.get(q, {})[r] for r in sorted(got.get(q, {}))]
        assert len(mine) == len(scored) and mine == sorted(mine)
        assert all(any(abs(d - math.dist(v, x)) < 1e-12 for j, x in all_ if j == c) for d, c in mine)
        hits += len({c for _, c in mine} & {c for _, c in scored})
        total += len({c for _, c in scored})
    return hits / max(total, 1)


def test_ann_recall(spark):
    assert recall(spark, vectors(3000, 32) + ODD) >= 0.95
    assert recall(spark, vectors(1500, 16, spread=0.2) + [(9000 + i, vectors(10, 16)[0][1], "") for i in range(300)], cells=3200, batch=5, seeds=20) >= 0.95


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 1.0], "") for i in random.Random(1).sample(range(400), 400)]
    got = [r["vec_id"] for r in ann.nearest(table(spark, rows)).where("query_id = 200").sort("rank").collect()]
    assert got == list(range(10))
    got = [r["vec_id"] for r in maxscore.top_k(table(spark, rows)).where("query_id = 0").sort("rank").collect()]
    assert got == list(range(1, 21))


def test_empty_tables_and_few_rows(spark):
    for rows in ([], ODD[:5], [(0, [1.0], "")]):
        assert maxscore.top_k(table(spark, rows)).collect() == [] == ann.nearest(table(spark, rows)).collect()


def test_chi_square():
    assert abs(ann.chi_square(15.507, 8) - 0.95) < 1e-4 and abs(ann.quantile(0.95, 8) - 15.507) < 1e-3


def test_maxscore_takes_each_vector_of_a_repeated_id(spark):
    rows = [(20, [1.0, 0.0], ""), (3, [2.0, 0.0], ""), (3, [1.0, 5.0], ""), (3, [1.0, 5.0], ""), (4, [1.001, 0.0], ""), (4, [1.002, 0.0], ""), (20, [0.0, 1.0], "")]
    got = [tuple(r) for r in maxscore.top_k(table(spark, rows)).sort("rank").collect()]
    # both vectors of the query's id are queries, as in the SQL; 4's two have the same whole numbers
    both = [(320 * 64, 3), (320 * 64, 3), (128 * 64, 3), (4096, 3), (4096, 3), (4096, 4), (4096, 4), (0, 3), (0, 4), (0, 4)]
    assert [(s, i) for _, _, i, s in got] == both
