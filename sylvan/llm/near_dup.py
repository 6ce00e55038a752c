"""SimHash near-duplicates by true Jaccard similarity: the pipeline's stage.

Two texts are near-duplicates when their sets of five-word shingles (64-bit hashes; words as
operator 4 has them) have a Jaccard similarity of 0.8 or more, and groups are connected by
such pairs. Operator 4's Golay-code keys give the first candidates: SimHash fingerprints of the
shingle sets that differ in at most two bits. Each candidate is verified on the whole sets.

At a similarity of 0.8 two fingerprints of 64 bits differ in ten bits on average, which no key of
operator 4 reaches. So that no link is lost, a prefix-filter join closes the components that the
fingerprints have found: in one order of all shingles, two sets that reach a similarity of t share a
shingle among the first n - ceil(t * n) + 1 of each, and at the first such shingle enough of
both is left to reach it (positional filter). Pairs of one component need no comparison. Of the others
those go whose shingles, counted in 256 cells, differ in too many of them or can't share enough; the rest is verified
on the whole sets. Any order is right; the one used puts the shingles last that are common
in a sample of the texts, so that few texts meet at them.

Where texts of several components meet, each is at first compared with one of those it meets only. When
few pairs of different components are left, or after ``STARS`` rounds, all of them are compared. So
components are those of all pairs, but a group of near copies costs no square of its size.

Texts of less than five words are one shingle. Null, empty and blank texts have none and are
copies of each other. Texts with equal sets are joined once. Texts of any length are compared whole; an
empty table gives an empty one; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.llm import simhash
from sylvan.llm.components import components
from sylvan.runtime import discard, free, materialise, numbered, release, ship

SEED = 42
WORDS = 5
#: Least similarity, as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: One text of so many is looked at for the order of the shingles.
SAMPLE = 32
#: Shingles that the order puts last, at most.
COMMON = 65_536
#: Rounds of comparisons with one text, at most.
STARS = 6
#: All pairs of different components are compared when at most so many meet for each row that may meet another.
FEW = 64
#: Cells of a set's histogram.
CELLS = 256
#: Rows whose sets are wanted, or that go, are looked up by broadcast up to this many.
BROADCAST_KEYS = 200_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64).view(np.int64)
    digest = xxhash.xxh64_intdigest
    each = zip(*(words[i:] for i in range(WORDS)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(t), SEED) for t in each), np.uint64, len(words) - WORDS + 1).view(np.int64))


def name(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    import xxhash

    n = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def ranked(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The first shingles of a set in the order of (count if common, hash), as many as a similar set must meet; and
    how common the set's shingles are on average."""
    n = len(found)
    if not n:
        return found, 0.0
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        often = np.where(common[at] == found, counts[at], 0)
    return found[np.argsort(often, kind="stable")][: n - -(-PART * n // WHOLE) + 1], float(often.mean())


def parity(found: np.ndarray) -> np.ndarray:
    """Which cells hold an odd number of the set's shingles, as four longs: two sets that differ in d shingles
    differ in at most d cells."""
    odd = np.bincount(found & (CELLS - 1), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def histogram(found: np.ndarray) -> bytes:
    """How many shingles fall in each cell; nothing where a number doesn't fit."""
    cells = np.bincount(found & (CELLS - 1), minlength=CELLS)
    return cells.astype("<u2").tobytes() if cells.max() < 1 << 16 else b""


def may_share(a: bytes, b: bytes) -> bool:
    """Whether sets of these histograms may reach the similarity: they share no more than the cells' minima."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    return bool((PART + WHOLE) * np.minimum(x, y).sum() >= PART * (x.sum() + y.sum()))


def similar(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles that share so many reach the similarity."""
    return (PART + WHOLE) * shared >= PART * (n + m)


def may_be_near(n: Column, m: Column, odd: Column, odd_: Column) -> Column:
    """Whether sets of n and m shingles with these parities may reach the similarity."""
    differ = sum((F.bit_count(odd[i].bitwiseXOR(odd_[i])) for i in range(CELLS // 64)), F.lit(0))
    return (PART + WHOLE) * differ <= (WHOLE - PART) * (n + m)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def _common(rows: DataFrame, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample hold, ascending, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], names=["shingle"])
        release()

    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(run, "shingle long")
    found = some.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(most).collect()
    found = sorted((r["shingle"], r["count"]) for r in found)
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def prints(rows: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, rank and row of each of ``rows``, ``fp`` that names its set, the SimHash of the set (``sim``), the
    set's size ``n``, its prefix and how common its shingles are, parity (``odd``) and histogram (``cells``)."""
    given = rows.select("doc_id", "rank", "row", "text")
    added = {"fp": F.lit(0).cast("long"), "sim": F.lit(0).cast("long"), "n": F.lit(0), "prefix": F.array(F.lit(0).cast("long")), "often": F.lit(0.0), "odd": F.array(F.lit(0).cast("long")), "cells": F.lit(b"")}
    schema, names = given.drop("text").withColumns(added).schema, ["doc_id", "rank", "row", *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column(3).to_pylist()]
            first = [ranked(s, common, counts) for s in sets]
            parts = [
                pa.array([name(s) for s in sets], pa.int64()),
                pa.array([simhash.of_set(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                _lists([x for x, _ in first]),
                pa.array([x for _, x in first], pa.float64()),
                _lists([parity(s) for s in sets]),
                pa.array([histogram(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *parts], names=names)
        release()

    return given.mapInArrow(run, schema)


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and the whole set (``held``) of the wanted (fp, row)."""
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(x) for x in batch.column(1).to_pylist()])], names=["fp", "held"])
        release()

    return rows.select("row", "text").join(wanted, "row").select("fp", "text").mapInArrow(run, "fp long, held array<long>")


def _possible(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those that their histograms don't rule out."""
    both = pairs.join(cells.toDF("u", "a"), "u").join(cells.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_share(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose sets reach the similarity."""
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    return both.where(similar(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v")


def by_fingerprint(known: DataFrame) -> DataFrame:
    """Candidates (u, v) of operator 4: one set for each fingerprint meets the others of that fingerprint, and those
    that stand for the fingerprints at two bits or less. ``known``: fp and sim of distinct sets."""
    sims = materialise(known.groupBy("sim").agg(F.min("fp").alias("first")), "near-sims")
    near = simhash.links(sims.select(F.col("sim").alias("fp")))  # both are read until the candidates are written
    same = known.join(sims, "sim").where("fp <> first").select("first", "fp")
    ends = near.join(sims.toDF("u", "a"), "u").join(sims.toDF("v", "b"), "v").select("a", "b")
    return same.union(ends).toDF("u", "v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def classes(rows: DataFrame, sample: int = SAMPLE, most: int = COMMON, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Prints of all rows, and (node, root) of the sets that have near-duplicates: one root for each component.

    ``rows``: doc_id, text, rank (what tells rows of one doc_id apart), and row as :func:`numbered` gives it."""
    ship(rows.sparkSession)
    rows = rows.withColumn("text", F.col("text").cast("string"))
    marks = materialise(prints(rows, *_common(rows, sample, most)), "near-prints")
    posts = marks.select("fp", "n", F.posexplode("prefix").alias("pos", "shingle"))
    each = Window.partitionBy("shingle")
    met = posts.withColumns({"lo": F.min("fp").over(each), "hi": F.max("fp").over(each)}).where("lo < hi").drop("lo", "hi")
    met = materialise(met.distinct(), "near-met")
    known = marks.join(met.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("row", "sim", "often", "odd", "cells")).alias("m"))
    known = materialise(known.select("fp", "m.row", "m.sim", "m.often", "m.odd", "m.cells"), "near-known")

    def compared(candidates: DataFrame) -> DataFrame:
        pairs = materialise(_possible(candidates, known.select("fp", "cells")), "near-pairs")
        ends = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
        wanted = materialise(known.select("fp", "row").join(ends, "fp", "left_semi"), "near-wanted")
        sets = materialise(_sets(rows, wanted), "near-sets")
        found = materialise(_verified(pairs, sets), "near-links")
        discard(pairs, wanted, sets)
        return found

    links = compared(by_fingerprint(known.select("fp", "sim")))
    roots, turn = components(links), 0
    while True:
        at = met.join(roots, met["fp"] == roots["node"], "left").select(met["*"], F.coalesce("root", "fp").alias("c"))
        at = materialise(at, "near-at")
        # shingles at which several components meet, and how many pairs of different ones
        held = at.groupBy("shingle", "c").count().groupBy("shingle")
        held = held.agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        held = materialise(held, "near-held")
        size = held.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
        last = turn >= STARS or turn > 0 and (size["pairs"] or 0) <= few * (size["rows"] or 0)
        left = at.join(held.select("shingle"), "shingle", "left_semi")
        left = materialise(left if turn else left.join(known.select("fp", "often", "odd"), "fp"), "near-left")
        discard(at, held, met)
        met = left.drop("c")
        met._sylvan_path = left._sylvan_path  # noqa: SLF001
        carried = ("fp", "n", "pos", "odd", "c")
        if last:
            other = left.select("shingle", *[F.col(x).alias(f"{x}_") for x in carried])
            pairs = left.join(other, "shingle").where("fp < fp_")
        else:  # at first with the set of the commonest shingles: in a group of copies the one that most are near to
            order = [] if turn else [-F.col("often")]
            pivot = F.min(F.struct(*order, F.xxhash64("fp", F.lit(turn)), *[F.col(x).alias(f"{x}_") for x in carried]))
            pairs = left.join(left.groupBy("shingle").agg(pivot.alias("p")).select("shingle", *[f"p.{x}_" for x in carried]), "shingle")
        share = similar(F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")), F.col("n"), F.col("n_"))
        pairs = pairs.where((F.col("c") != F.col("c_")) & share & may_be_near(F.col("n"), F.col("n_"), F.col("odd"), F.col("odd_")))
        found = compared(pairs.select(F.least("fp", "fp_").alias("u"), F.greatest("fp", "fp_").alias("v")).distinct())
        both = materialise(links.union(found).distinct(), "near-links")
        discard(links, found, roots)
        links, roots, turn = both, components(both), turn + 1
        if last:
            discard(met, known, links)
            return marks, roots


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each group of near-duplicates, whole: the one of the smallest doc_id (null last); rows that share it
    are told apart by a hash of their columns."""
    (row,) = free(docs, "row")
    given = numbered(docs, row)
    marks, roots = classes(given.select("doc_id", "text", simhash.order_of(docs).alias("rank"), F.col(row).alias("row")), **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rank", "row")).alias("first")
    # rows of one set first, so that a large group is added up before it is dealt out
    each = materialise(marks.groupBy("fp").agg(first), "near-first")
    group = each.join(roots, each["fp"] == roots["node"], "left").withColumn("group", F.coalesce("root", "fp"))
    kept = group.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    gone = materialise(marks.select(F.col("row").alias(row)).join(kept, row, "left_anti"), "near-gone")
    discard(marks, each, roots)
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return given.join(gone, row, "left_anti").drop(row)
