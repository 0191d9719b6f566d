"""Stupid backoff against a plain count of every n-gram."""

import math
import random
import re
from collections import Counter

import pytest

from tallyloom.llm import backoff


def plain(rows, order):
    texts = [[w for w in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] for _, t in rows]
    grams = [Counter(tuple(w[i - k : i]) for k in range(1, order + 1) for i in range(k, len(w) + 1)) for w in texts]
    every = sum(grams, Counter())
    corpus = sum(map(len, texts))
    out = []
    for (i, _), w, own in zip(rows, texts, grams):
        c = lambda g: every[g] - own[g]  # noqa: E731, B023
        total = 0.0
        for at in range(1, len(w) + 1):
            factor = 1.0
            for k in range(min(order, at), 1, -1):
                g = tuple(w[at - k : at])
                if c(g) > 0:
                    s = c(g) / c(g[:-1])
                    break
                factor *= backoff.ALPHA
            else:
                s = max(c((w[at - 1],)), backoff.UNKNOWN) / max(1, corpus - len(w))
            total += math.log(s * factor)
        out.append((str(i), len(w), round(total, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_counts(spark, odd_docs, order):
    r = random.Random(4)
    rows = [(i + 100, " ".join(r.choice(["a", "B", "cc", "dé", "e,"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    rows.append((2**62 + 1, "a b"))
    docs = odd_docs.select("doc_id", "text", "shard", "ids").unionByName(spark.createDataFrame([(*x, "s", "t") for x in rows], "doc_id long, text string, shard string, ids string"))
    got = backoff.score(docs.repartition(3), order, block_bytes=900, tokens_per_bucket=3000).collect()
    assert sorted((str(x.doc_id), x.n_tokens, round(x.log_score, 6)) for x in got) == plain([(x.doc_id, x.text) for x in docs.collect()], order)
    assert all((x.mean_log_score is None) == (x.n_tokens == 0) for x in got)


def test_empty_and_single(spark, no_docs):
    assert backoff.score(no_docs).count() == 0
    one = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    for order, steps in ((2, 2), (3, 3)):  # of the tokens' n-grams beyond words, one and two backoff steps
        assert [round(x.log_score, 9) for x in backoff.score(one, order).collect()] == [round(3 * math.log(0.5) + steps * math.log(0.4), 9)]
