import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylvan.llm import bpe, token_count

PIECES = ["word", " ", "  ", "\n", "\n\n", "\t", "don't", "I'll", "'", "é", "日本語", "123", "!!!", "\u00a0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "a" * 70, "🙂", "re", "'re", ".", ", ", "x\u0301", "\u1c89"]
texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=60).map("".join).filter(lambda s: s.isascii() or not any(0xD800 <= ord(c) < 0xE000 for c in s))


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TREES = {n: bpe.TreeBpe(*bpe.default_ranks(), leaf=n) for n in (1, 7, 512, 8192)}
COUNTERS = [token_count.TokenCounter(*token_count.default_file()), token_count.TokenCounter(*token_count.default_file(), chunk=16, overlap=2), token_count.TokenCounter(*token_count.default_file(), chunk=5, overlap=1)]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_equal_the_library(text):
    lib = COUNTERS[0].lib
    want = len(lib.encode(text, add_special_tokens=False).ids)
    assert [c.count(text) for c in COUNTERS] == [want] * len(COUNTERS)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_tree_equals_the_library(text):
    for tree in TREES.values():
        ids = tree.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == tree.core.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(0, 10_000), st.integers(0, 10_000))
def test_join_is_associative(text, i, j):
    tree = TREES[7]
    n = len(text)
    if n < 3:
        return
    i, j = sorted((1 + i % (n - 1), 1 + j % (n - 1)))
    if i == j:
        return
    a, b, c = tree.span(text, 0, i), tree.span(text, i, j), tree.span(text, j, n)
    assert tree.join(text, tree.join(text, a, b), c) == tree.join(text, a, tree.join(text, b, c))


def test_a_long_text_without_spaces_and_one_of_spaces(tik, lib):
    for text in ("ab" * 40_000, " " * 3000 + "x" + "\n" * 3000, "Wort " * 30_000, "'" * 70_000):
        assert np.frombuffer(TREES[8192].encode(text), "<u4").tolist() == tik.encode_ordinary(text)
        assert COUNTERS[0].count(text) == len(lib.encode(text, add_special_tokens=False).ids)


ROWS = [(1, "Hello world, it's 5 o'clock.", "x"), (1, "Hello world, it's 5 o'clock.", "x"), (2, None, "y"), (3, "", None), (None, "no id", "z"), (4, "lang " * 40_000, "z")]


def test_operators_on_odd_rows(spark, tik, lib):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")  # a column of a clashing name
    got = sorted((tuple(r) for r in bpe.digest(docs).collect()), key=str)
    want = []
    for i, t, _ in ROWS:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    counts = sorted((tuple(r) for r in token_count.count_tokens(docs).collect()), key=str)
    assert counts == sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in ROWS), key=str)
    ids = {r["doc_id"]: r["token_ids"] for r in bpe.encode_with_digest(docs.withColumn("source", docs["n_tokens"])).collect() if r["doc_id"]}
    assert ids[2] == [] and ids[1] == tik.encode_ordinary(ROWS[0][1])


def test_operators_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(docs).collect() == [] == token_count.count_tokens(docs).collect()
