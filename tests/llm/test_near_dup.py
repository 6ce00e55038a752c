import random
from itertools import combinations

import pytest

import corpus_pipeline
from sylvan.llm import near_dup, simhash
from tests.llm.test_simhash import brute_components


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near(a, b):
    return a == b or bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    rng = random.Random(11)
    names = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    line = rng.choices(names, k=30)
    out = []
    for _ in range(25):
        base = rng.choices(names, k=rng.randint(5, 150)) + line * rng.randint(0, 2)
        for _ in range(rng.randint(1, 5)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(names)
    big = rng.choices(names, k=120)
    for _ in range(40):  # a large group of near copies
        one = list(big)
        for at in rng.sample(range(120), 2):
            one[at] = rng.choice(names)
        out.append(" ".join(one))
    out += [None, "", " ", "one", "One", "two words", "a b c d e", "A B C D E", "a b c d f"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"sample": 1, "few": 0}, {"sample": 2, "most": 5}])
def test_against_brute_force(spark, tmp_path, options):
    texts = corpus()
    sets = [brute_set(t) for t in texts]
    root = brute_components([(a, b) for a, b in combinations(range(len(texts)), 2) if near(sets[a], sets[b])], range(len(texts)))
    want = {}
    for i in range(len(texts)):
        want.setdefault(root[i], i)
    assert len(want) < len({frozenset(s) for s in sets}) - 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = [r["doc_id"] for r in near_dup.keep_one(spark.read.parquet(str(tmp_path / "d")), **options).collect()]
    assert sorted(got) == sorted(want.values())


def test_histograms_rule_out_no_near_duplicate():
    sets = [near_dup.shingles(t) for t in corpus()]
    cells = [near_dup.histogram(s) for s in sets]
    ruled_out = 0
    for a, b in combinations(range(len(sets)), 2):
        possible = near_dup.may_share(cells[a], cells[b])
        ruled_out += not possible
        assert possible or not near(set(sets[a].tolist()), set(sets[b].tolist()))
    assert ruled_out > len(sets)


def test_parities_rule_out_no_near_duplicate():
    sets = [near_dup.shingles(t) for t in corpus()]
    odd = [near_dup.parity(s) for s in sets]
    ruled_out = 0
    for a, b in combinations(range(len(sets)), 2):
        differ = sum(int(x ^ y).bit_count() for x, y in zip(odd[a].view("u8").tolist(), odd[b].view("u8").tolist(), strict=True))
        possible = 9 * differ <= len(sets[a]) + len(sets[b])
        ruled_out += not possible
        assert possible or not near(set(sets[a].tolist()), set(sets[b].tolist()))
    assert ruled_out > len(sets)


def test_the_fingerprints_find_links_of_their_own(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(1500)]
    texts = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 1500, 100)] + ["other words of a text of its own"]
    sets = {near_dup.name(s): s for s in map(near_dup.shingles, texts)}
    known = spark.createDataFrame([(n, simhash.of_set(s)) for n, s in sets.items()], "fp long, sim long")
    got = {(r["u"], r["v"]) for r in near_dup.by_fingerprint(known).collect()}
    true = {tuple(sorted(p)) for p in combinations(sets, 2) if near(set(sets[p[0]].tolist()), set(sets[p[1]].tolist()))}
    assert len(true) == 105 and len(got) > 3 and got <= true


def test_the_stage_drops_a_copy_that_differs_in_many_bits(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    other = [*words[:50], "x", *words[51:150], "y", *words[151:]]
    assert near(brute_set(" ".join(words)), brute_set(" ".join(other)))
    rows = [(3, " ".join(words), "en", "s", 1), (2, " ".join(other), "en", "s", 1), (None, " ".join(words), "en", "s", 1), (4, " ".join(words[:150]), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "d")), "")
    assert got.columns == list(corpus_pipeline.COLUMNS) and sorted(r["doc_id"] for r in got.collect()) == [2, 4]
    empty = spark.read.parquet(str(tmp_path / "d")).where("doc_id > 9")
    assert near_dup.keep_one(empty).collect() == []
