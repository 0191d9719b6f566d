"""The packing index against BM25 written out plainly, one pair of documents at a time."""

import math
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm.packing import B, K1, Index, Stats, plan


def plain(units: list[list[int]], seed: int, other: int, df: Counter, n: int, mean: float) -> float:
    tf, score = Counter(units[other]), 0.0
    for term in set(units[seed]) & set(tf):
        idf = math.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        score += idf * tf[term] * (K1 + 1) / (tf[term] + K1 * (1 - B + B * len(units[other]) / mean))
    return score


@pytest.mark.parametrize("rows", [1, 7, 60])
@pytest.mark.parametrize("corpus", [False, True], ids=["own statistics", "corpus statistics"])
def test_scores_equal_plain_bm25(rows, corpus):
    random = np.random.default_rng(rows)
    units = [np.minimum(random.zipf(1.4, random.integers(1, 80)), 300).astype(np.uint32) for _ in range(rows)]
    units += units[: rows // 3]  # copies
    df = Counter(t for u in units for t in set(u.tolist()))
    n, mean = len(units), sum(map(len, units)) / len(units)
    if corpus:  # the shard is a part of a larger corpus
        df, n, mean = Counter({t: 3 * k for t, k in df.items()}), 5 * n, mean + 10
    counts = np.zeros(1 << 16, np.int64)
    counts[list(df)] = list(df.values())
    index, lists = Index(units, None, Stats(n, mean, counts) if corpus else None), [u.tolist() for u in units]
    want = np.array([[plain(lists, a, b, df, n, mean) for b in range(len(units))] for a in range(len(units))])
    assert np.allclose([index.scores(a) for a in range(len(units))], want, rtol=1e-4)
    alive = np.arange(len(units)) % 3 != 1
    index.keep(alive)  # the others' scores go, these stay
    assert np.allclose([index.scores(a) for a in range(len(units))], want * alive, rtol=1e-4)


def test_plan_places_every_id_once_and_fills_windows():
    random = np.random.default_rng(1)
    units = [np.minimum(random.zipf(1.4, random.integers(1, 200)), 300).astype(np.uint32) for _ in range(150)]
    rows = plan([len(u) for u in units], Index(units), 256)
    assert [sum(n for *_, n in r) for r in rows[:-1]] == [256] * (len(rows) - 1)
    placed = Counter((u, start + k) for r in rows for u, start, n in r for k in range(n))
    assert set(placed.values()) == {1} and len(placed) == sum(map(len, units))
    assert plan([], Index([]), 256) == []


def test_two_levels_of_trees_deal_like_topics_together(spark, monkeypatch):
    """With a small bound on the sample, leaves are split by trees of their own: all rows once, in the shards numbered, and topics together."""
    from tallyloom.llm import packing

    random = np.random.default_rng(4)
    rows = []
    for i in range(600):
        topic = i % 30
        ids = np.concatenate([random.integers(topic * 100, topic * 100 + 60, 50), random.integers(40_000, 40_030, 10)]).astype("<u4")
        rows.append((i, ids.tobytes()))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    encoded = spark.createDataFrame(rows, "doc_id long, ids binary").repartition(3)
    calls, second = [], packing._second
    monkeypatch.setattr(packing, "_second", lambda *a: calls.append(a[1]) or second(*a))

    def together(sample):
        dealt, shards, _ = packing.deal(encoded, 2048, 20, 10**9, sample)
        got = [(r.shard, r.doc_id) for r in dealt.select("shard", "doc_id").collect()]
        assert sorted(i for _, i in got) == sorted(i for i, _ in rows) and all(0 <= s < shards for s, _ in got)
        topics = {}
        for s, i in got:
            if i < 600:
                topics.setdefault(i % 30, Counter())[s] += 1
        return sum(c.most_common(1)[0][1] for c in topics.values()) / 600

    assert together(1 << 16) > 0.6 and not calls
    assert together(64) > 0.6 and calls  # four leaves, then a tree in each
    monkeypatch.setattr(packing, "_second", lambda dealt, *a: dealt)
    assert together(64) < 0.6
