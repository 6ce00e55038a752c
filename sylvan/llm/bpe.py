"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 10).

``encode`` splits a text in halves until a span is at most ``LEAF`` characters,
encodes the leaves, and joins neighbours. A span's value is the monoid element

    (ids, first cut, ids before it, last cut, ids before it)

where a *cut* is a space between two characters that are not white space. The
pre-split pattern has no look-behind, no piece holds a space after anything but
white space, and one space before a non-space always opens a new piece; so a cut
is a piece boundary whatever surrounds it, and ids on either side of it do not
depend on the other side. Joining A and B keeps A's ids before its last cut and
B's ids from its first cut, and re-encodes only the window between these. The
window grows (by doubling) until it meets a cut or the end of the span: tokens
outside it are proven stable. A text without any cut is re-encoded whole, which
is the same definition and needs no other path.

Null texts count as empty: no ids. Texts of any length are encoded whole. Repeated rows are encoded each. An empty
table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.runtime import release, ship

#: Characters of a leaf.
LEAF = 512
#: Remembered words of a worker; the memory is emptied when full.
MEMO = 100_000
CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Words(dict):
    """Ids of ' ' + word. None for what isn't cut off by safe spaces."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if len(self) >= MEMO:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids


@dataclass(frozen=True)
class Span:
    """A span of the text and its ids (little-endian unsigned 32-bit)."""

    lo: int
    hi: int
    ids: bytes
    first: int | None = None
    before_first: int = 0
    last: int | None = None
    before_last: int = 0


class TreeBpe:
    """Encoder and decoder over a rank file."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaf = leaf
        self.words = _Words(self.plain)

    def plain(self, text: str) -> bytes:
        """Ids of a text by the library, in one piece."""
        return np.asarray(self.core.encode_ordinary(text), dtype="<u4").tobytes()

    def leaf_ids(self, text: str) -> bytes:
        """Ids of a leaf: word by word from memory where all its spaces are cuts."""
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.plain(text)
        try:
            return self.plain(first) + b"".join(map(self.words.__getitem__, rest))
        except TypeError:  # a space that is no cut
            return self.plain(text)

    def first_cut(self, text: str, lo: int, hi: int) -> int | None:
        """The first cut inside the span, by windows that double."""
        at, width = lo + 1, 64
        while at < hi:
            if m := CUT.search(text, at, min(hi, at + width)):
                return m.start()
            at, width = max(at + 1, at + width - 2), width * 2
        return None

    def last_cut(self, text: str, lo: int, hi: int) -> int | None:
        """The last cut inside the span, by windows that double."""
        width = 64
        while True:
            start = max(lo + 1, hi - width)
            found = None
            for found in CUT.finditer(text, start, hi):
                pass
            if found:
                return found.start()
            if start == lo + 1:
                return None
            width *= 2

    def span(self, text: str, lo: int, hi: int) -> Span:
        """The monoid element of text[lo:hi], from scratch."""
        ids = self.leaf_ids(text[lo:hi])
        first = self.first_cut(text, lo, hi)
        if first is None:
            return Span(lo, hi, ids)
        last = self.last_cut(text, lo, hi)
        return Span(lo, hi, ids, first, len(self.leaf_ids(text[lo:first])), last, len(ids) - len(self.leaf_ids(text[last:hi])))

    def join(self, text: str, a: Span, b: Span) -> Span:
        """The monoid's operation: only the window around the seam is encoded again."""
        start, kept = (a.lo, b"") if a.last is None else (a.last, a.ids[: a.before_last])
        end, rest = (b.hi, b"") if b.first is None else (b.first, b.ids[b.before_first :])
        middle = self.leaf_ids(text[start:end])
        ids = kept + middle + rest
        if a.first is not None:
            first, before_first = a.first, a.before_first
        else:  # the seam itself, or what follows, holds the first cut
            first = self.first_cut(text, a.lo, b.hi)
            before_first = 0 if first is None else len(kept) + len(self.leaf_ids(text[start:first]))
        if b.last is not None:
            last, before_last = b.last, len(ids) - (len(b.ids) - b.before_last)
        else:
            last = None if first is None else self.last_cut(text, a.lo, b.hi)
            before_last = 0 if last is None else len(ids) - len(self.leaf_ids(text[last : b.hi]))
        return Span(a.lo, b.hi, ids, first, before_first, last, before_last)

    def reduce(self, text: str, lo: int, hi: int) -> Span:
        if hi - lo <= self.leaf:
            return self.span(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join(text, self.reduce(text, lo, mid), self.reduce(text, mid, hi))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return self.leaf_ids(text) if len(text) <= self.leaf else self.reduce(text, 0, len(text)).ids

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids: leaves by the table, neighbours concatenated up the tree."""
        n = len(ids) // 4
        if n <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        mid = n // 2 * 4
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def engine(ranks_path: str, pattern: str) -> TreeBpe:
    return TreeBpe(ranks_path, pattern)


def default_ranks() -> tuple[str, str]:
    """Rank file and pattern of the public vocabulary; looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _ids_and_digest(bpe: TreeBpe, text: str | None) -> tuple[bytes, str, str]:
    ids = bpe.encode(text)
    return ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode_with_digest(docs: DataFrame, ranks: tuple[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns to ``keep``, ``token_ids`` (array of int), n_tokens, ids_sha256 and
    decoded_sha256 of every row."""
    ship(docs.sparkSession)
    n = 2 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(*(ranks or default_ranks()))
        for batch in batches:
            done = [_ids_and_digest(bpe, x) for x in batch.column(n).to_pylist()]
            columns = [
                *batch.columns[:n],
                pa.array([np.frombuffer(ids, dtype="<i4") for ids, _, _ in done], pa.list_(pa.int32())),
                pa.array([len(ids) // 4 for ids, _, _ in done], pa.int64()),
                pa.array([a for _, a, _ in done], pa.string()),
                pa.array([b for _, _, b in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", *keep, "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *keep, F.col("text").cast("string").alias("text"))
    kept = "".join(f"{c} {kind}, " for c, kind in given.dtypes[2:n])
    return given.mapInArrow(run, f"doc_id long, source string, {kept}token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(docs: DataFrame, ranks: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, repeated rows included."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = engine(*(ranks or default_ranks()))
        for batch in batches:
            done = [_ids_and_digest(bpe, x) for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(ids) // 4 for ids, _, _ in done], pa.int64()), pa.array([a for _, a, _ in done], pa.string()), pa.array([b for _, _, b in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
