"""License scans by patience alignment (operator 1).

Texts and templates are compared as words (letters and digits, lower case). A template
is found where a stretch of at most ``len(template) + slack`` words holds at least
``need`` of its words in order. Stretches are first bounded: no order of its words can
give a stretch more than the words it shares with the template (counted with their
repetitions), and none more than their longest common subsequence, whose length is counted in the bits of a number;
so only stretches that may give enough, and more than the best one so far aligned, are aligned. Alignment anchors on words that are unique in both, keeps the longest
increasing subsequence of the anchors, and aligns the gaps between them recursively;
a gap without unique words is closed by the longest common subsequence. Coverage is
the share of the template's words that are aligned.

An anchor may tie a word to the wrong one of two places, so an alignment can fall short of the longest
common subsequence: a stretch whose words reach the need only barely may be missed. That is the method's price.

Null and empty texts, and texts without any template, have a null license. Texts of any length are scanned whole. An
empty table gives an empty one; other columns play no part. Every row, also a repeated one, is
judged by itself; of templates that are found, the one with the most aligned words is
reported (ties: greater coverage, then name), and all are listed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.license_texts import LICENSES
from sylvan.runtime import ship

WORD = re.compile(r"[^\W_]+")
#: Share of a template's words that must align; of templates up to ``SHORT`` words, all.
COVERAGE, SHORT = 0.8, 14
SCHEMA = "doc_id long, license string, coverage double, matched_words int, start_char long, end_char long, found array<string>"


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ascending in the first) that strictly ascends in both, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str], a0: int, b0: int) -> list[tuple[int, int]]:
    """Longest common subsequence, as the longest increasing one of all matching pairs."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    # positions of a word descend, so at most one of them is kept
    return [(a0 + i, b0 + j) for i, j in longest_increasing([(i, j) for i, w in enumerate(a) for j in where.get(w, ())])]


def patience(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of two lists of words, ascending in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(a0 + i, b0 + i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        out += _between(x, y, a0 + head, b0 + head)
    return out + [(a0 + len(a) - tail + i, b0 + len(b) - tail + i) for i in range(tail)]


def _between(a: list[str], b: list[str], a0: int, b0: int) -> list[tuple[int, int]]:
    in_a, in_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    anchors = longest_increasing([(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in place])
    if not anchors:
        return common_subsequence(a, b, a0, b0)
    out, i0, j0 = [], 0, 0
    for i, j in [*anchors, (len(a), len(b))]:
        if i > i0 and j > j0:
            out += patience(a[i0:i], b[j0:j], a0 + i0, b0 + j0)
        if i < len(a):
            out.append((a0 + i, b0 + j))
        i0, j0 = i + 1, j + 1
    return out


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def need(self) -> int:
        return len(self.words) if len(self.words) <= SHORT else math.ceil(COVERAGE * len(self.words))

    @cached_property
    def places(self) -> dict[str, int]:
        """For each word the bits of its positions."""
        out: dict[str, int] = {}
        for i, w in enumerate(self.words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    @property
    def stretch(self) -> int:
        return len(self.words) + max(1, len(self.words) // 4)


def template(name: str, text: str) -> Template:
    words = tuple(WORD.findall(text.lower()))
    if not words:
        raise ValueError(f"template {name!r} has no words")
    return Template(name, words)


TEMPLATES = tuple(template(n, t) for n, t in LICENSES.items())


@dataclass(frozen=True)
class Hit:
    name: str
    matched: int
    coverage: float
    first: int
    last: int


def stretches(words: list[str], t: Template) -> Iterator[tuple[int, int]]:
    """Start of each stretch that shares enough words, and how many it shares."""
    wanted = Counter(t.words)
    held: Counter = Counter()
    shared, size = 0, t.stretch
    for end, w in enumerate(words, 1):
        if w in wanted:
            held[w] += 1
            shared += held[w] <= wanted[w]
        if end > size:
            out = words[end - 1 - size]
            if out in wanted:
                shared -= held[out] <= wanted[out]
                held[out] -= 1
        if shared >= t.need:
            yield max(0, end - size), shared


def common_length(t: Template, words: list[str]) -> int:
    """Length of the longest common subsequence with the template: a row of the table is the bits of a number."""
    row = whole = (1 << len(t.words)) - 1
    for w in words:
        if mask := t.places.get(w):
            met = row & mask
            row = (row + met | row - met) & whole
    return len(t.words) - row.bit_count()


def find(words: list[str], templates: tuple[Template, ...]) -> list[Hit]:
    """The best hit of each template that is found."""
    present = set(words)
    out = []
    for t in templates:
        if sum(w in present for w in t.words) < t.need:
            continue
        best, next_ = None, 0
        for at, shared in stretches(words, t):
            wanted = best.matched + 1 if best else t.need
            if at < next_ or shared < wanted:
                continue
            stretch = words[at : at + t.stretch]
            # no alignment is longer than the longest common subsequence, which a step can lengthen by one word only
            if (longest := common_length(t, stretch)) < wanted:
                next_ = at + wanted - longest
                continue
            next_ = at + 1
            pairs = patience(list(t.words), stretch, 0, at)
            if len(pairs) >= wanted:
                best = Hit(t.name, len(pairs), len(pairs) / len(t.words), pairs[0][1], pairs[-1][1])
        if best:
            out.append(best)
    return out


def scan_text(text: str | None, templates: tuple[Template, ...] = TEMPLATES) -> tuple:
    """license, coverage, matched_words, start_char, end_char, found."""
    lower = (text or "").lower()
    hits = find(WORD.findall(lower), templates)
    if not hits:
        return (None, None, None, None, None, [])
    top = min(hits, key=lambda h: (-h.matched, -h.coverage, h.name))
    # lower-casing may change a text's length: offsets are counted in the text itself
    spans = [m.span() for m in WORD.finditer(text if len(lower) == len(text) else lower)]
    return (top.name, top.coverage, top.matched, spans[top.first][0], spans[top.last][1], sorted(h.name for h in hits))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id and what :func:`scan_text` finds, for every row of ``docs``. Offsets are characters of the
    lower-cased text where lower-casing changes its length."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        names = ("license", "coverage", "matched_words", "start_char", "end_char", "found")
        for batch in batches:
            rows = [scan_text(x, templates) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
