"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 4).

A fingerprint's 64 bits are cut into three segments A, B, C of 22, 21 and 21 bits.
Two fingerprints that differ in at most two bits agree in some segment, and the
segment that follows it (A to B, B to C, C to A) then holds at most one of the
errors, or the agreeing segment can be chosen so: errors in two segments leave
the third whole, and whichever follows it holds one of them; two errors in one
segment leave two whole segments, of which one is followed by the other.

So the keys are (whole segment, Golay codeword near the next one). The [23,12,7]
Golay code is perfect: every 23-bit word has one codeword within distance 3. If x
and y differ in one bit, y's nearest codeword lies within distance 4 of x. Each
fingerprint therefore gives its nearest codeword once, and lists all codewords
within distance 4 (one, or six where the nearest is at distance 3): the join of
both lists misses no link. Candidates are verified by counting differing bits.

Only distinct fingerprints are joined. A key under which more than ``PAIRS`` pairs
would meet is dealt with exactly and without pairs: the fingerprints under such
keys each name themselves and their 64 neighbours at one bit, and two that name
the same value differ in at most two bits; all that name a value are linked to the
smallest of them. Components are found by contraction in the cluster; nothing of
all documents reaches the driver.

Null texts count as empty, empty texts have fingerprint zero and are linked like
any other. Rows with a null doc_id take part and name no component. Texts of any length
are fingerprinted whole; repeated rows are returned each, with one component; an empty
table gives an empty one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.components import components
from sylvan.runtime import discard, free, materialise, numbered, release, ship

SEED = 42
WORDS = 3
DISTANCE = 2
#: Shingles that are hashed and added up at a time.
STEP = 65_536
#: Pairs that may meet under one key before its fingerprints are linked through their neighbours.
PAIRS = 64
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23,12,7] Golay code.
GENERATOR = 0xC75


def majority(sums: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes, as an unsigned number."""
    return int(sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist()))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The text's SimHash as an unsigned number."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, sums, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - WORDS + 1
    for at in range(0, n, STEP):
        part = words[at : at + STEP + WORDS - 1]
        sums += bit_sums(np.array([digest(b" ".join(t), SEED) for t in zip(part, part[1:], part[2:])], dtype="<u8"))
    return majority(sums, n)


def of_set(found: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed number; zero for none."""
    sums = sum((bit_sums(found[at : at + STEP].view(np.uint64)) for at in range(0, len(found), STEP)), np.zeros(64, np.int64))
    return _signed(majority(sums, len(found)))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprints(docs: DataFrame, *ids: str) -> DataFrame:
    """The id columns of each row and ``fp``, its fingerprint as a signed long."""
    ship(docs.sparkSession)
    given = docs.select(*[F.col(f"`{c}`") for c in ids], F.col("text").cast("string").alias("__text"))
    schema = given.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(x)) for x in batch.column(len(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(fps, pa.int64())], names=[*ids, "fp"])
        release()

    return given.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight at most 3, whether it has weight 3, and the five
    patterns of weight 4 that a syndrome of weight 3 has besides."""
    from itertools import combinations

    one = [_syndromes(np.array([1 << i], np.int64))[0] for i in range(23)]
    error, three, four = np.zeros(2048, np.int64), np.zeros(2048, bool), [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s, e = 0, 0
            for i in places:
                s, e = s ^ int(one[i]), e | 1 << i
            if weight < 4:
                error[s], three[s] = e, weight == 3
            else:
                four[s].append(e)
    return error, three, np.array([x or [0] * 5 for x in four], np.int64)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword; positions in ``words``, and indices, of those at distance 4
    that words at distance 3 from their nearest list besides."""
    error, three, four = golay()
    s = _syndromes(words)
    far = np.flatnonzero(three[s])
    others = (words[far, None] ^ four[s[far]]) >> 11
    return (words ^ error[s]) >> 11, np.repeat(far, 5), others.ravel()


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``fps``, keys, and whether the key is of a nearest codeword (else it is listed only)."""
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    where, key, near = [], [], []
    for i in range(3):
        nearest, at, others = codewords(seg[(i + 1) % 3])
        high = np.int64(i) << 36 | seg[i] << 12
        where += [np.arange(len(fps)), at]
        key += [high | nearest, high[at] | others]
        near += [np.ones(len(fps), bool), np.zeros(len(at), bool)]
    return np.concatenate(where), np.concatenate(key), np.concatenate(near)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, key, near = keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(key), pa.array(near)], names=["fp", "key", "near"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long, near boolean")


def links(distinct: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Pairs (u < v) of fingerprints that hold every link within two bits, those under crowded keys
    by way of a smallest neighbour: connected alike, and each at most two bits apart from its partner.

    ``distinct``: a written table of distinct fingerprints.
    """
    spark = distinct.sparkSession
    keyed = _keyed(distinct)
    sizes = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.when(F.col("near"), 1)).alias("n"), F.count(F.lit(1)).alias("m"))
    live = materialise(sizes.where("lo < hi and n > 0").select("key", (F.col("n") * F.col("m") > pairs).alias("crowded")), "simhash-keys")
    met = materialise(keyed.join(live, "key"), "simhash-met")
    calm = met.where("not crowded")
    near = calm.where("near").select("key", F.col("fp").alias("a"))
    pair = near.join(calm.select("key", F.col("fp").alias("b")), "key").where(F.col("a") != F.col("b"))
    pair = pair.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    pair = pair.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    hot = met.where("crowded").select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    named = hot.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    least = named.groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("hi")).where("u < hi").select("value", "u")
    star = named.join(least, "value").where("fp > u").select("u", F.col("fp").alias("v"))
    out = materialise(pair.union(star).distinct(), "simhash-links")
    discard(live, met)
    return spark.read.schema(out.schema).parquet(out._sylvan_path)  # noqa: SLF001


def classes(docs: DataFrame, *ids: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (ids, fp), and a row (fp, root, component) for each distinct fingerprint:
    a fingerprint that stands for the class, and the smallest doc_id reachable. ``ids`` begins with doc_id."""
    fps = materialise(fingerprints(docs, *ids), "simhash-fps")
    least = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    roots = components(links(least))
    linked = materialise(least.join(roots, least["fp"] == roots["node"]).select("fp", "root", "doc_id"), "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = linked.join(smallest, "root").select("fp", "root", "component")
    table = least.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component"))
    return fps, materialise(table, "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps, table = classes(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    out = fps.join(table, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, whole: the one of the smallest doc_id (null last); rows that share it are told
    apart by a hash of their columns."""
    (row, rank) = free(docs, "row", "rank")
    rows = numbered(docs, row).withColumn(rank, order_of(docs))
    fps, table = classes(rows.select("doc_id", "text", row, rank), "doc_id", row, rank)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(rank).alias("rank"), F.col(row).alias("row"))).alias("first")
    # rows of one fingerprint first, so that a large group is added up before it is dealt out
    each = materialise(fps.groupBy("fp").agg(first), "simhash-first")
    kept = each.join(table, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.drop(rank).join(kept, row, "left_semi").drop(row)


def order_of(docs: DataFrame) -> Column:
    """A hash of the columns that can be compared: rows that agree in it are interchangeable."""
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map", "variant"))]
    return F.xxhash64(*rest)
