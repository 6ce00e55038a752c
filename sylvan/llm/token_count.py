"""Token counts by overlap resynchronisation (operator 3).

A text is encoded in chunks that overlap, with offsets. A *piece boundary*
is the offset where the pre-splitter starts a piece. The pre-splitter scans left
to right without look-behind, so from a true boundary on it behaves alike
whatever came before; and it looks at most two characters past a piece's end, so
a boundary that lies two characters before the chunk's end (or at the text's end)
is not changed by what follows. The left chunk's boundaries are true by
induction. Where the right chunk has a boundary at the same offset as a stable
boundary of the left one, both agree from there on: the counts are spliced there.
If the overlap holds no such offset it is doubled and the left chunk encoded
again, at worst to the end of the text.

All texts go this way; one of ``CHUNK`` characters or less is one chunk, with nothing to splice. A chunk's pieces come
from the vocabulary's pattern, and the tokens of each piece from the library, remembered by the worker; chunks with
characters whose class differs between versions of Unicode are encoded by the library itself, with its offsets.
Strings of added tokens (such as an end-of-text mark) split the text first, as
the library does by default.

Null texts count as empty: zero bytes, zero tokens. Repeated rows are counted each. An empty table gives an empty one;
other columns play no part.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.bpe import MEMO
from sylvan.runtime import ship

#: Characters of a chunk, and of the overlap at first.
CHUNK = 1_024
OVERLAP = 64
#: Longer pieces are not remembered.
LONG = 64
#: Tokens from which a document is over the limit.
LIMIT = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters whose class (letter, digit, white space, other) is the same in every version of Unicode.
SETTLED = re.compile("[\t\n\r\x20-\x7e\xa1-ſ‐-‧‰-⁞]*")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies print each byte as one character: visible Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenCounter:
    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.chunk, self.overlap = chunk, overlap
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        plain = all(not t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.simple = plain and spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space")
        self.split_added = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.core = self._core(spec, pattern) if self.simple else None
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = _Counts(self.core)

    def _core(self, spec: dict, pattern: str):
        """A faster engine for the same vocabulary, if merges rank as their results' ids."""
        import tiktoken

        byte_of = byte_alphabet()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"].get(a + b) for a, b in pairs]
        if None in made or any(x >= y for x, y in zip(made, made[1:])):
            return None
        return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def pieces(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        """Offsets in the text at which pieces of text[lo:hi] start, and tokens before each; then the end of both."""
        chunk = text[lo:hi]
        if self.core is not None and SETTLED.fullmatch(chunk):
            found = self.split.findall(chunk)
            return list(accumulate(map(len, found), initial=lo)), list(accumulate(map(self.known.__getitem__, found), initial=0))
        enc = self.lib.encode(chunk, add_special_tokens=False)
        starts, counts, last = [], [], None
        for i, (w, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
            if w != last:
                starts.append(lo + a)
                counts.append(i)
                last = w
        return [*starts, hi], [*counts, len(enc.ids)]

    def spliced(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        end, total = len(text), 0
        lo, hi = 0, min(end, self.chunk + self.overlap)
        left, since = self.pieces(text, lo, hi), 0  # since: tokens of the left chunk before the last splice
        while hi < end:
            seam = max(hi - self.overlap, lo + 1)
            overlap = self.overlap
            to = min(end, seam + self.chunk + self.overlap)
            right = self.pieces(text, seam, to)
            while True:
                first = bisect_left(left[0], seam)
                stable = {p: c for p, c in zip(left[0][first:], left[1][first:], strict=True) if p + 2 <= hi or hi == end}
                meet = next(((stable[p], c, p) for p, c in zip(*right, strict=True) if p in stable and p < to), None)
                if meet or hi == end:
                    break
                overlap *= 2  # alignment failed: the left chunk reaches further
                hi = min(end, seam + overlap)
                if hi > to - 2 and to < end:
                    to = min(end, hi + self.chunk)
                    right = self.pieces(text, seam, to)
                left = self.pieces(text, lo, hi)
            if not meet:
                return total + left[1][-1] - since
            total += meet[0] - since
            lo, hi, left, since = seam, to, right, meet[1]
        return total + left[1][-1] - since

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.simple:  # a tokenizer that normalizes, or doesn't split at byte level
            return len(self.lib.encode(text, add_special_tokens=False).ids)
        parts = [text]
        if self.split_added is not None and any(a in text for a in self.added):
            parts = self.split_added.split(text)
        return len(parts) - 1 + sum(self.spliced(p) for p in parts if p)


class _Counts(dict):
    """Tokens of a piece. A piece by itself is split into itself."""

    def __init__(self, core):
        self.core = core

    def __missing__(self, piece: str) -> int:
        n = len(self.core.encode_ordinary(piece))
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def engine(path: str, pattern: str) -> TokenCounter:
    return TokenCounter(path, pattern)


def default_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def count_tokens(docs: DataFrame, limit: int = LIMIT, file: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``; other columns play no part."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = engine(*(file or default_file()))
        for batch in batches:
            n = [counter.count(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, SCHEMA)
