"""Mixing sources to target weights (operator 8), in DataFrame functions only.

Each source's rows are cut into blocks of ``block`` rows, in an order that is
shuffled by MD5 of the seed and the row's id. A source of weight ``q / Q`` (integer
quota q of Q) releases its block j at slot ``floor(j * Q / q)`` and must have sent
it by slot ``ceil((j + 1) * Q / q)``; each slot sends, of the released blocks, the
one with the earliest deadline (ties: the order in which quotas are given). This
Pfair schedule never deviates from the targets by a whole block. When a source is
used up, a new phase starts in which the others keep their quotas; the bound holds
in each phase. No row is dropped or repeated.

The schedule of a phase repeats after Q slots, so only that period is computed on
the driver: at most Q entries for each of at most as many phases as there are
quotas, whatever the size of the input. A block's slot is then arithmetic. Ranks
inside a source are counted in pieces of the MD5 range, so that a source of a
third of all rows is no task's burden.

Sources without a quota of their own, null included, share ``OTHER``'s. Repeated
rows count each; rows that agree in all columns are interchangeable. Rows of one doc_id
(a null one counts as an empty text) are told apart by a hash of all their columns. Texts play no
part, however long. An empty table gives an empty one, and columns of any name pass through.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylvan.runtime import free

OTHER = "other"
#: Target weights, in hundredths.
QUOTAS = {"src0": 20, "src1": 10, "src2": 8, "src3": 6, "src4": 4, "src5": 4, "src6": 4, "src7": 4, "src8": 4, "src9": 4, OTHER: 32}
BLOCK = 16
SEED = "mix-1"
#: Hex digits of the MD5 by which a source's rows are dealt out: 4,096 pieces of each source.
DIGITS = 3
#: Rows of a file of :func:`in_order`, at most; fewer where the cluster's cores would lack work.
ROWS = 65_536


def period(quotas: dict[str, int]) -> list[str]:
    """One period of the schedule by earliest deadline first: the source of each slot."""
    total = sum(quotas.values())
    sent = dict.fromkeys(quotas, 0)
    slots = []
    for t in range(total):
        ready = [g for g in quotas if sent[g] * total // quotas[g] <= t]
        chosen = min(ready, key=lambda g: -(-(sent[g] + 1) * total // quotas[g]))
        sent[chosen] += 1
        slots.append(chosen)
    return slots


def phases(blocks: dict[str, int], quotas: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """From how many blocks each source has: rows (group, phase, first block, blocks, first slot,
    quota, slots of a period), and rows (phase, group, number in the period, slot in the period)."""
    left = {g: n for g, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    spans, places, first_slot, phase = [], [], 0, 0
    while left:
        own = {g: q for g, q in quotas.items() if g in left}
        slots, total = period(own), sum(own.values())
        at: dict[str, list[int]] = {g: [] for g in own}
        for s, g in enumerate(slots):
            at[g].append(s)
        # the phase ends with the slot that sends some source's last block
        end = min((n - 1) // own[g] * total + at[g][(n - 1) % own[g]] for g, n in left.items())
        for g, q in own.items():
            sent = (end + 1) // total * q + sum(s < (end + 1) % total for s in at[g])
            spans.append((g, phase, done[g], sent, first_slot, q, total))
            done[g] += sent
            left[g] -= sent
        places += [(phase, g, i, s) for g in own for i, s in enumerate(at[g])]
        left = {g: n for g, n in left.items() if n}
        first_slot, phase = first_slot + end + 1, phase + 1
    return spans, places


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    names = [part.split()[0] for part in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def mix(docs: DataFrame, quotas: dict[str, int] = QUOTAS, block: int = BLOCK, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, source and any others) with ``mix_group``,
    ``mix_block`` (number in its source), ``mix_slot`` and ``mix_rank`` (slot * block + place in
    the block): ordered by mix_rank, the sources interleave. Such columns in the input are replaced."""
    added = ["mix_group", "mix_block", "mix_slot", "mix_rank"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    return schedule(docs, added, quotas, block, seed, digits)


def schedule(docs: DataFrame, names: list[str], quotas: dict[str, int] = QUOTAS, block: int = BLOCK, seed: str = SEED, digits: int = DIGITS) -> DataFrame:
    """All rows and columns of ``docs`` with the schedule's columns by ``names`` that no column of ``docs`` has:
    group, block, slot and rank as :func:`mix` has them."""
    if OTHER not in quotas or min(quotas.values()) < 1:
        raise ValueError(f"quotas are whole numbers from 1, and {OTHER!r} has one")
    spark = docs.sparkSession
    g, h, p, n, at, b, j, k, first, many, slot0, q, total, phase, place, before = free(docs, "g", "h", "p", "n", "at", "b", "j", "k", "first", "many", "slot0", "q", "total", "phase", "place", "before")
    own = [x for x in quotas if x != OTHER]
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumns({
        g: F.when(F.col("source").isin(own), F.col("source")).otherwise(F.lit(OTHER)) if own else F.lit(OTHER),
        h: key,
    })
    rows = rows.withColumn(p, F.substring(h, 1, digits))
    counts = rows.groupBy(g, p).agg(F.count(F.lit(1)).alias(n))
    earlier = F.sum(n).over(Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(g, p, F.coalesce(earlier, F.lit(0)).alias(before))
    sizes = {r[0]: r[1] for r in counts.groupBy(g).agg(F.sum(n)).collect()}  # a row for each quota at most
    spans, places = phases({x: -(-size // block) for x, size in sizes.items()}, quotas)

    # rows that agree in doc_id and source are told apart by all that can be compared
    rest = [F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map", "variant"))]
    tie = [F.col("doc_id"), F.col("source"), F.xxhash64(*rest)] if rest else []
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(g, p).orderBy(h, *tie)) - 1)
    rows = rows.join(starts, [g, p]).withColumn(at, F.col(at) + F.col(before)).withColumn(b, F.floor(F.col(at) / block))
    # both tables are bounded by the quotas, not by the input
    span = F.broadcast(literal(spark, spans, f"{g} string, {phase} int, {first} bigint, {many} bigint, {slot0} bigint, {q} bigint, {total} bigint"))
    spot = F.broadcast(literal(spark, places, f"{phase} int, {g} string, {k} bigint, {place} bigint"))
    rows = rows.join(span, g).where((F.col(b) >= F.col(first)) & (F.col(b) < F.col(first) + F.col(many)))
    rows = rows.withColumn(j, F.col(b) - F.col(first)).withColumn(k, F.col(j) % F.col(q)).join(spot, [phase, g, k])
    slot = F.col(slot0) + F.floor(F.col(j) / F.col(q)) * F.col(total) + F.col(place)
    group_, block_, slot_, rank_ = names
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col(g).alias(group_),
        F.col(b).cast("long").alias(block_),
        slot.cast("long").alias(slot_),
        (slot * block + F.col(at) % block).cast("long").alias(rank_),
    )


def in_order(docs: DataFrame, rows_a_file: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the schedule: written, files in order of name and rows in order
    within hold consecutive ranks. Ranks are dense, so a row's file is arithmetic and no range is sampled."""
    names = free(docs, "mix_group", "mix_block", "mix_slot", "mix_rank")
    rank = names[3]
    n = docs.count()
    if rows_a_file is None:
        rows_a_file = min(ROWS, max(1, -(-n // (4 * docs.sparkSession.sparkContext.defaultParallelism))))
    files = max(1, -(-n // rows_a_file))
    placed = schedule(docs, names).repartitionById(files, F.least(F.floor(F.col(rank) / rows_a_file), F.lit(files - 1)).cast("int"))
    return placed.sortWithinPartitions(rank).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(quotas: dict[str, int] = QUOTAS, block: int = BLOCK, seed: str = SEED) -> str:
    """DuckDB SQL that sends block after block: an independent simulation of the schedule, one
    recursion step a slot."""
    values = ", ".join(f"({i}, '{g}', {q})" for i, (g, q) in enumerate(quotas.items(), 1))
    names = ", ".join(f"'{g}'" for g in quotas if g != OTHER)
    return f"""
with recursive quota(i, g, q) as (values {values}),
ranked as (
  select doc_id, source, g, row_number() over (partition by g order by h, doc_id, source) - 1 as i
  from (select doc_id, source, case when source in ({names}) then source else '{OTHER}' end as g,
          md5('{seed}:' || coalesce(cast(doc_id as varchar), '')) as h from documents)),
have as (select quota.i, quota.g, quota.q, coalesce(n, 0) as n from quota left join
          (select g, cast(ceil(count(*) / {block}.0) as bigint) as n from ranked group by g) using (g)),
lists as (select list(q order by i) as q, list(n order by i) as n from have),
sim(slot, t, sent, remaining, chosen, q) as (
  select cast(-1 as bigint), cast(0 as bigint), list_transform(n, lambda x: cast(0 as bigint)), n, 0, q from lists
  union all
  select slot + 1, case when over then 0 else t + 1 end,
    case when over then list_transform(sent, lambda x: cast(0 as bigint)) else list_transform(sent, lambda x, k: x + case when k = pick then 1 else 0 end) end,
    list_transform(remaining, lambda x, k: x - case when k = pick then 1 else 0 end), pick, q
  from (
    select *, remaining[pick] = 1 as over from (
      select *, list_position(due, list_min(due)) as pick from (
        select *, list_transform(q, lambda x, k: case when remaining[k] > 0 and sent[k] * w < (t + 1) * x
                 then -(-((sent[k] + 1) * w) // x) else null end) as due
        from (select *, list_sum(list_transform(q, lambda x, k: case when remaining[k] > 0 then x else 0 end)) as w from sim where list_sum(remaining) > 0)))
  )),
sent_blocks as (select slot, quota.g, row_number() over (partition by quota.g order by slot) - 1 as b
                from sim join quota on chosen = quota.i where slot >= 0)
select doc_id, source, ranked.g as mix_group, cast(b as bigint) as mix_block, slot as mix_slot,
  cast(slot * {block} + ranked.i % {block} as bigint) as mix_rank
from ranked join sent_blocks on ranked.g = sent_blocks.g and ranked.i // {block} = b
"""
