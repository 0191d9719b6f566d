"""Search by norm buckets against scoring every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, df = len(counts), sum(x[2] for x in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for i, c, size in counts:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(size):
    r = random.Random(size)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(500)] + ["The", "É", "日本", "x_y", "\x7f"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for i in range(12)]
    items += [(3, "w1 w1 w1"), (3, "w1 w1 w1"), (20, None), (21, ""), (22, "--"), (23, "nowhere-at-all"), (None, "w2 w3"), items[0]]
    docs = [(i, "  ".join(r.choice(words) for _ in range(int(r.paretovariate(0.8)) % 900))) for i in range(size)]
    docs += [(i, items[i % 12][1]) for i in range(size, size + 8)] + [(5, "w1 w2"), (None, items[0][1]), (None, "w1"), (-7, None), (-8, ""), (-9, "..."), (-10, "w9 " * 30_000)] + docs[:20] + [(1000 + i, "w2 w3 w4") for i in range(40)]
    return docs, items


@pytest.mark.parametrize(("block", "lead", "focus", "at_once", "k"), [(4096, 32, 0.5, 2048, 10), (8, 4, 0.95, 9, 3)])
def test_equals_scoring_every_pair(spark, block, lead, focus, at_once, k):
    docs, items = corpus(250)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n string, bucket int").repartition(5)
    q = spark.createDataFrame([(i, t, 0.5) for i, t in items], "item_id long, text string, score double")
    got = lexical.search(d, q, k, block, lead, focus, at_once)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k)
    assert got.schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_buckets_are_passed_over():
    """A bucket of short vectors isn't touched, and inside one only documents whose bound reaches the threshold are scored."""
    r = np.random.default_rng(1)
    sizes = r.integers(1, 30, 400)
    found = [np.sort(r.choice(100, s, False)) for s in sizes]
    v = r.integers(1, 10**6, sizes.sum())
    items = lexical.Items([Counter({3: 1, 50: 2, 99: 1})], r.integers(1, 9000, 100))
    bucket = lexical.Bucket(np.arange(400), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(found), v, items.roots)
    every = bucket.exact(items, 0, np.arange(400))
    scored = []
    bucket.exact = lambda own, i, rows: scored.append(len(rows)) or every[rows]
    rows, scores = bucket.best(items, 0, 1, 5, 0.1)
    assert scores.tolist() == sorted(every.tolist(), reverse=True)[:5] and (every[rows] == scores).all()
    assert sum(scored) < 100
    scored.clear()
    assert len(bucket.best(items, 0, int(items.lengths[0] * bucket.norms[0] * 1.01), 5, 0.5)[0]) == 0 and not scored


def test_lengths_beyond_64_bits():
    got = lexical.impacts(np.array([1, 7]), np.array([10**9, 3]), 10**12, 10**15)
    m = [25 + (75 * n * 10**12) // 10**15 for n in (10**9, 3)]
    assert got.tolist() == [10**9 // (1000 + 8 * m[0]), 7 * 10**9 // (7000 + 8 * m[1])]


def test_no_rows(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "fox word")], "item_id long, text string")
    assert lexical.search(no_docs, items).collect() == [] and lexical.search(odd_docs, items.limit(0)).collect() == []
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, lexical.search(odd_docs, items).collect()), key=str) == plain(rows, [(1, "fox word")])
