import random
import zlib
from itertools import product

import numpy as np
import pytest

from sylvan.llm import toxicity


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    good = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["zorg" + "".join(rng.choices("abcdef", k=3)) for _ in range(40)] + ["snarf", "blick"]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.15)
        words = rng.choices(good, k=rng.randint(5, 60)) + (rng.choices(bad, k=4) if toxic else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "idiot idiot", "c"), (3, "x " * 300_000, None)], "doc_id long, text string, score string")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 5 and all(r["predicted"] == 0 for r in rows if r["doc_id"] in (1, 2)) and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    clean = toxicity.keep_clean(odd, model)
    assert clean.columns == odd.columns and clean.count() >= 4
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_without_labels_the_lexicon_decides(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels.limit(0))
    assert model.score("you stupid idiot") > 0.5 > model.score("a kind word") and model.score(None) < 0.5
    strange = spark.createDataFrame([(1, 1, 7), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, strange) == toxicity.Model()


def votes(n=4000, seed=0):
    """True classes, and votes: the given label (wrong at 8 % of rows), four voters, and a copy of the last."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    given = y ^ (rng.random(n) < 0.08)
    fires = rng.random((n, 4)) < np.where(y[:, None], [0.9, 0.7, 0.6, 0.5], [0.02, 0.05, 0.1, 0.02])
    copy = np.where(rng.random(n) < 0.05, rng.random(n) < 0.5, fires[:, 3])
    return y, np.column_stack([given, fires, copy]).astype(float)


def test_label_model_beats_noisy_labels_and_knows_copies():
    y, fires = votes()
    model = toxicity.label_model(fires)
    found = model.posterior(fires) > 0.5
    assert (found == y).mean() > 0.965 > 0.94 > (fires[:, 0] == y).mean()
    rate = model.rates[:, 0, :]
    assert np.abs(rate[1, :4] - [0.92, 0.9, 0.7, 0.6]).max() < 0.04 and abs(rate[0, 0] - 0.08) < 0.02
    assert {(4, 5), (5, 4)} & {(j, int(p)) for j, p in enumerate(model.parent)} and model.parent[0] == -1
    j = 5 if model.parent[5] == 4 else 4
    assert model.rates[1, 1, j] > 0.9 > 0.2 > model.rates[1, 0, j]  # the copy follows its parent in either class
    # a copy adds next to nothing to what its parent says
    one, both = np.zeros((1, 6)), np.zeros((1, 6))
    one[0, 4], both[0, 4:] = 1, 1
    alone = toxicity.label_model(fires[:, :5]).posterior(one[:, :5])[0]
    assert abs(model.posterior(both)[0] - alone) < 0.1


def test_label_model_against_enumeration():
    _, fires = votes(800, 4)
    model = toxicity.label_model(fires, (2,))
    every = np.array(list(product([0.0, 1.0], repeat=6)))
    joint = np.zeros((len(every), 2))
    for i, row in enumerate(every):
        for c in (0, 1):
            p = model.share if c else 1 - model.share
            for j, v in enumerate(row):
                up = int(row[model.parent[j]]) if model.parent[j] >= 0 else 0
                p *= model.rates[c, up, j] if v else 1 - model.rates[c, up, j]
            joint[i, c] = p
    assert abs(joint.sum() - 1) < 1e-9
    assert np.allclose(np.exp(model.joint(every)), joint) and np.allclose(model.posterior(every), joint[:, 1] / joint.sum(axis=1), atol=1e-6)


def test_training_on_the_posterior_beats_noisy_labels(spark):
    docs, labels = corpus(1500, 8)
    rng = random.Random(6)
    noisy = [(i, q, t if rng.random() > 0.12 else 1 - t) for i, q, t in labels]
    frame, truth = spark.createDataFrame(docs, "doc_id long, text string"), {i: t for i, _, t in labels}
    given = spark.createDataFrame(noisy, "doc_id long, quality int, toxic int")
    wrong = {}
    for posterior in (True, False):
        model = toxicity.train(frame, given, posterior=posterior)
        wrong[posterior] = sum((model.score(t) >= 0.5) != truth[i] for i, t in docs if zlib.crc32(str(i).encode()) % 5 == 0)
    assert wrong[True] <= wrong[False] and wrong[True] <= 0.05 * len(docs) / 5
