"""Toxicity and quality: held-out accuracy on planted signals, bounds of the fit, and odd cases."""

import random

import numpy as np
import pytest

from tallyloom.llm import common, quality, toxicity

R = random.Random(8)
WORDS = ["".join(R.choice("aeioulmnrst") for _ in range(R.randint(2, 7))) for _ in range(500)]
BAD = ["scum", "vile", "stupid"]
LABELS = "doc_id long, quality int, toxic int, text string, y int"


def documents(n=900):
    docs, labels = [], []
    for i in range(n):
        w = [R.choice(WORDS) for _ in range(R.randint(5, 150))]
        toxic, poor = int(i % 4 == 0), int(i % 3 == 0)
        if toxic:
            w.insert(R.randrange(len(w)), R.choice(BAD))
        if poor:
            w = [x.upper() + "!!" if R.random() < 0.8 else x for x in w]
        docs.append((i, " ".join(w), "en", 0.5, 9, True))
        labels.append((i, 1 - poor, toxic, "other", 3))
    return docs, labels


DOCS = "doc_id long, text string, lang string, score double, predicted int, held_out boolean"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = documents()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(("operator", "column", "number"), [(toxicity.toxicity, "toxic", 2), (quality.quality, "quality", 1)])
def test_held_out_accuracy_and_odd_cases(spark, tables, operator, column, number):
    docs, labels = tables
    odd = spark.createDataFrame([(5000, None, "", None, None, None), (5001, "", "", None, None, None), (5002, " \n", "", None, None, None), (5003, "word " * 30_000, "", None, None, None), (5003, "word " * 30_000, "", None, None, None), (None, "no id", "", None, None, None)], DOCS)
    more = spark.createDataFrame([(5000, None, None, "t", 1), (None, 1, 1, "t", 1), (0, None, None, "t", 1)], LABELS)
    rows = operator(docs.unionByName(odd), labels.unionByName(more)).collect()
    assert len(rows) == 906 and {tuple(r.asDict()) for r in rows} == {("doc_id", "held_out", "score", "predicted")}
    truth = {r.doc_id: r[number] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 120 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[5003]) == 1 and by[5000] == by[5001]


@pytest.mark.parametrize(("operator", "predicted"), [(toxicity.toxicity, 0), (quality.quality, 1)])
def test_without_labels_or_rows(spark, tables, operator, predicted):
    docs, labels = tables
    assert {r.predicted for r in operator(docs.limit(5), labels.limit(0)).collect()} == {predicted}
    assert operator(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learned(spark, tables):
    docs, labels = tables
    kept = labels.where(~common.held_out())
    score = lambda x: {r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()}
    assert score(labels) == score(kept)


def test_ftrl_weights_are_sparse():
    r = np.random.default_rng(0)
    examples = [(np.unique(np.append(r.integers(100, 50_000, 60), [7] * (i % 3 == 0) + [toxicity.BIAS])), int(i % 3 == 0)) for i in range(1500)]
    at, w = toxicity.ftrl(examples)
    assert len(at) < 200 and w[at == 7][0] > 1


def test_gradients_match_differences():
    r = np.random.default_rng(2)
    x, counts, y = r.random((7, quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    net = quality.Network()
    net.parts = {k: v.astype(float) for k, v in net.parts.items()}

    def loss():
        s = net.scores(x, counts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in net.gradients(x, counts, y).items():
        flat, at = net.parts[k].reshape(-1), r.integers(net.parts[k].size)
        flat[at] += 1e-5
        up = loss()
        flat[at] -= 2e-5
        down = loss()
        flat[at] += 1e-5
        assert abs((up - down) / 2e-5 - np.asarray(g).reshape(-1)[at]) < 1e-5


def test_passages_of_a_text():
    x, counts = quality.describe([b"a " * 130, None, b"", b"one"])
    assert counts.tolist() == [3, 1, 1, 1] and x.shape == (6, quality.WIDTH)
