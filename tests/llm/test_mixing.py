from collections import Counter

import duckdb
import pytest

from sylvan.llm import mixing


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string")


def test_a_period_stays_within_a_block():
    for quotas in (mixing.QUOTAS, {"a": 1, "other": 1}, {"a": 7, "b": 2, "c": 2, "other": 1}, {"other": 3}, {"a": 50, "b": 49, "other": 1}):
        slots, total, sent = mixing.period(quotas), sum(quotas.values()), Counter()
        for t, g in enumerate(slots, 1):
            sent[g] += 1
            assert all(abs(sent[x] - q * t / total) < 1 for x, q in quotas.items())
        assert sent == Counter(quotas)


def test_every_slot_has_one_block_and_phases_keep_the_bound():
    quotas, blocks = {"a": 5, "b": 3, "other": 2}, {"a": 40, "b": 7, "other": 90}
    spans, places = mixing.phases(blocks, quotas)
    at = {(p, g, k): s for p, g, k, s in places}
    slots = {}
    for g, p, first, many, slot0, q, total in spans:
        for j in range(many):
            slots[slot0 + j // q * total + at[p, g, j % q]] = g
    assert sorted(slots) == list(range(sum(blocks.values()))) and Counter(slots.values()) == Counter(blocks)


@pytest.mark.parametrize("block", [1, 4])
def test_against_sql_and_whole(spark, block):
    quotas = {"a": 5, "b": 3, mixing.OTHER: 2}
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else f"s{i % 7}"), "t", None) for i in range(150)] + [(None, None, None, None), (5, "a", "t", None), (5, "a", "u", None), (7, "other", "", "x")]
    table = docs(spark, rows)
    got = mixing.mix(table, quotas, block)
    con = duckdb.connect()
    arrow = table.toArrow()  # noqa: F841
    con.execute("create view documents as select * from arrow")
    names = "doc_id, source, mix_group, mix_block, mix_slot, mix_rank"
    want = con.execute(f"select {names} from ({mixing.oracle(quotas, block)})").fetchall()
    assert sorted((tuple(r) for r in got.select(*names.split(", ")).collect()), key=str) == sorted(want, key=str)
    assert got.select("mix_rank").distinct().count() == len(rows)
    assert sorted(map(str, got.select("doc_id", "source", "text").collect())) == sorted(map(str, table.select("doc_id", "source", "text").collect()))


def test_empty_table_and_one_source(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    got = mixing.mix(docs(spark, [(i, "zz", "", "") for i in range(40)]))
    assert sorted(r["mix_rank"] for r in got.collect()) == list(range(40))
