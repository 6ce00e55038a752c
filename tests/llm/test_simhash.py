import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sylvan.llm import simhash
from sylvan.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 64 * 5 + 1]
    error, three, four = simhash.golay()
    assert [int((np.array([e.bit_count() for e in error.tolist()]) == k).sum()) for k in range(4)] == [1, 23, 253, 1771]
    assert three.sum() == 1771 and all(len(set(r)) == 5 for r, t in zip(four.tolist(), three, strict=True) if t)
    nearest, _, _ = simhash.codewords(words)
    code = nearest << 11
    code |= simhash._syndromes(code)
    assert max(int(x).bit_count() for x in (code ^ words).tolist()) <= 3


def test_keys_miss_no_pair_within_two_bits():
    rng = random.Random(5)
    for _ in range(40):
        x = rng.getrandbits(64)
        for e in [(), *((i,) for i in range(64)), *rng.sample(list(combinations(range(64), 2)), 60)]:
            y = x
            for i in e:
                y ^= 1 << i
            at, key, near = simhash.keys(np.array([simhash._signed(x), simhash._signed(y)], np.int64))
            listed = {int(k) for a, k in zip(at, key, strict=True) if a == 0}
            assert listed & {int(k) for a, k, n in zip(at, key, near, strict=True) if a == 1 and n}


@pytest.mark.parametrize("pairs", [0, 64])
def test_links_connect_what_brute_force_connects(spark, pairs):
    rng = random.Random(7)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = [simhash._signed(x) for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = [tuple(r) for r in simhash.links(table, pairs).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a < b for a, b in got)
    true = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    one, two = brute_components(got, signed), brute_components(true, signed)
    assert len(set(one.values())) == len(set(two.values())) and all(two[a] == two[b] for a, b in got)
    if pairs:
        assert set(got) == {(min(p), max(p)) for p in true}


def test_components_of_paths_cliques_and_nothing(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000 + a, 1000 + b) for a, b in combinations(range(12), 2)] + [(5, 5), (2000, 2001), (2001, 2000)]
    rows = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    want = brute_components(edges, {x for e in edges for x in e})
    assert rows.keys() == want.keys() and len(set(rows.values())) == 3
    assert all(rows[a] == rows[b] for a, b in edges)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


TEXTS = [
    (4, "The quick brown fox jumps over the lazy dog " * 30), (2, "the QUICK brown fox jumps over the lazy dog " * 30), (9, "The quick brown fox jumps over the lazy dog " * 30 + "x"),
    (1, ""), (7, None), (3, "one"), (5, "One"), (6, "two words"), (8, "\x0btwo\twords\r\n"), (8, "\x0btwo\twords\r\n"), (None, "no id here"), (None, "no id here"), (10, "nb sp is one"), (11, "Ä b c d"), (12, "ä b c d"), (13, "word " * 200_000),
]


def test_near_duplicates_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(t for _, t in TEXTS)}
    near = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = brute_components(near, fps)
    want = []
    for i, (d, _) in enumerate(TEXTS):
        ids = [TEXTS[j][0] for j in fps if root[j] == root[i] and TEXTS[j][0] is not None]
        want.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    assert got == sorted(want, key=str)


def test_keep_one_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    classes = {(r["component_id"], r["fingerprint"] if r["component_id"] is None else "") for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(classes) and {x for x in got if x is not None} == {c for c, _ in classes if c is not None}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("local", [5, 40, 10_000])
def test_components_in_any_number_of_tasks(spark, local):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 501 + i) for i in range(50)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long").union(spark.createDataFrame([(None, 3)], "u long, v long"))
    got = {r["node"]: r["root"] for r in components(edges.repartition(6), local).collect()}
    want = brute_components([p for p in pairs if p[0] != p[1]], {x for p in pairs if p[0] != p[1] for x in p})
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in got})
