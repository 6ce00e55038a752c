import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from sylvan.llm import bpe, mixing, toxicity
from tests.llm.test_near_dup import brute_set, near
from tests.llm.test_simhash import brute_components
from tests.llm.test_toxicity import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs, labels = corpus(300)
    rng = random.Random(1)
    rows = [(i, t, "en", rng.choice(["src0", "src1", "new", None]), len(t)) for i, t in docs]
    rows += [(1000 + i, rows[i][1], "en", "src2", 5) for i in range(40)] + [rows[0], (2000, None, None, None, None), (2001, "", "en", "src3", 0)]
    rows += [(None, "a text without a number of its own", None, "src1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    clean = [r for r in rows if model.score(r[1]) < 0.5]
    assert len(clean) < len(rows)
    sets = [brute_set(r[1]) for r in clean]
    root = brute_components([(a, b) for a, b in combinations(range(len(sets)), 2) if near(sets[a], sets[b])], range(len(sets)))
    first = {}
    for i in sorted(range(len(clean)), key=lambda i: (clean[i][0] is None, clean[i][0] or 0)):
        first.setdefault(root[i], i)
    kept = [clean[i] for i in first.values()]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in got) == sorted(r[0] is None or r[0] for r in kept)
    tree = bpe.engine(*bpe.default_ranks())
    texts = {r[0]: r[1] for r in clean}
    assert all(r["token_ids"] == np.frombuffer(tree.encode(texts[r["doc_id"]]), "<i4").tolist() for r in got)
    # the mix has a lasting effect: by position, the rows are in the order of the schedule
    ranked = mixing.mix(spark.createDataFrame(kept, SCHEMA)).sort("mix_rank").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == [r["doc_id"] for r in ranked]


def test_stages_return_the_columns_and_keep_others(spark, folder, tmp_path):
    extra = ["row", "rank", "toxicity", "position", "mix_rank", "g", "p"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.selectExpr("*", *[f"doc_id as {c}" for c in extra]).write.parquet(str(tmp_path / "d"))
    more = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == list(corpus_pipeline.COLUMNS), name
        out = stage(spark, more, folder)
        assert out.columns == more.columns, name
        assert all(r[c] == r["doc_id"] for r in out.collect() for c in extra), name
    empty = spark.read.parquet(str(tmp_path / "d")).where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_mixing_orders_rows_over_many_files(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    mixing.in_order(docs, 50).write.parquet(str(tmp_path / "m"))
    placed, position = corpus_pipeline.ordered(spark.read.parquet(str(tmp_path / "m")))
    got = [r["doc_id"] for r in sorted(placed.collect(), key=lambda r: r[position])]
    assert got == [r["doc_id"] for r in mixing.mix(docs).sort("mix_rank").collect()]


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
