import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm import license_scan as L

word = st.sampled_from("abcdefgh")


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(word, max_size=14), st.lists(word, max_size=14))
def test_common_subsequence_is_longest_and_patience_aligns(a, b):
    pairs = L.common_subsequence(a, b, 0, 0)
    assert len(pairs) == brute_common(a, b)
    for found in (pairs, L.patience(a, b)):
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_patience_anchors_on_unique_words():
    a, b = "x the one the two the".split(), "the the one y two the the z".split()
    assert {(2, 2), (4, 4)} <= set(L.patience(a, b))


def test_planted_texts_are_found_and_clean_ones_left_alone():
    rng = random.Random(4)
    filler = ["".join(rng.choices("abcdeflmnoprstu", k=6)) for _ in range(500)] + ["the", "of", "license", "under", "software", "is"]
    for name, text in L.LICENSES.items():
        words = L.WORD.findall(text)
        if len(words) > 30:  # exactly one word in ten is replaced, as the scanner counts words
            for i in rng.sample(range(len(words)), len(words) // 10):
                words[i] = rng.choice(filler)
        noise = [rng.choice(filler) for _ in range(300)]
        got = L.scan_text(" ".join([*noise, *words, *noise, *words]))
        assert name in got[5], name
    for _ in range(50):
        assert L.scan_text(" ".join(rng.choices(filler, k=400)))[0] is None


def test_against_brute_force_on_all_stretches():
    rng = random.Random(9)
    t = L.template("t", "a b c d e f g a b h i j k l m n o p")
    found = short = 0
    for _ in range(300):
        words = [rng.choice("abcdefghijklmnopq") if rng.random() < 0.35 else t.words[i % len(t.words)] for i in range(50)]
        hits = L.find(words, (t,))
        every = [words[at : at + t.stretch] for at in range(len(words) - t.stretch + 1)]
        want = max(len(L.patience(list(t.words), x)) for x in every)
        assert [h.matched for h in hits] == ([want] if want >= t.need else [])
        longest = max(brute_common(list(t.words), x) for x in every)
        found, short = found + (longest >= t.need), short + (longest >= t.need > want)
        whole = words[5:20] + list(t.words) + words[20:]
        assert L.find(whole, (t,))[0].matched == len(t.words)
    assert found > 50 and short <= 0.05 * found  # the method's price


@settings(max_examples=200, deadline=None)
@given(st.lists(word, min_size=1, max_size=14), st.lists(word, max_size=20))
def test_common_length(a, b):
    assert L.common_length(L.Template("t", tuple(a)), b) == brute_common(a, b)


def test_shuffled_templates_take_no_long_time():
    rng = random.Random(2)
    words = [w for t in L.TEMPLATES for w in t.words] * 6
    rng.shuffle(words)
    began = time.process_time()
    L.find(words, L.TEMPLATES)
    assert time.process_time() - began < 20


def test_rows(spark):
    rows = [(1, "Foo. Released under the MIT License.\nBar", "x"), (1, "Foo. Released under the MIT License.\nBar", "x"), (2, None, "x"), (3, "", "x"), (None, "SPDX-License-Identifier: MIT", "x"), (4, "y " * 200_000 + L.LICENSES["mit"], "x"), (5, "İ " * 3 + "Licensed under CC BY-NC 4.0.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert len(L.scan(docs).collect()) == len(rows)
    one = got[1]
    assert (one["license"], one["coverage"], one["matched_words"]) == ("mit-line", 1.0, 5) and rows[0][1][one["start_char"] : one["end_char"]] == "Released under the MIT License"
    assert got[2]["license"] is None and got[2]["found"] == [] and got[3]["license"] is None
    assert got[None]["license"] == "spdx-mit" and got[4]["license"] == "mit" and got[5]["license"] == "cc-by-nc-4.0-line"
    assert L.scan(docs.limit(0)).collect() == []
