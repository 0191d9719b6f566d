"""The parity-sketch join against brute force over real shingles, its bounds, and its odd cases."""

import random
import re

import numpy as np

from tallyloom.llm import graphs, parity_join


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]


def shingles(text, k=5):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(x, y):
    n = len(x & y)
    return bool(x) and bool(y) and 100 * n >= 75 * (len(x) + len(y) - n)


def brute(rows):
    sets, out = [(i, shingles(t)) for i, t in rows], {}
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a][1], sets[b][1]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if group[j] == group[k] and sets[j][0] is not None]
        out.setdefault(i, set()).add((len(s), min(ids) if ids else None))
    return out


def corpus(n=260, seed=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(3)) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.35 and texts:  # a near copy
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, len(w) // 25 + 1])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.6:  # a passage that many share, at many rates
            own = [r.choice(vocabulary) for _ in range(r.choice([3, 10, 20, 60]))]
            texts.append(" ".join(passage[: r.choice([20, 40, 60])] + own))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 30, 100, 300]))))
    return texts


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x", "y", "z") for i, t in rows], "doc_id long, text string, n int, ent string, root string, component_id string")
    want, got = brute(rows), {}
    for r in parity_join.join(df.repartition(3)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got == want


def test_against_brute_force(spark):
    check(spark, list(enumerate(corpus(), 5)))


def test_crowded_near_copies(spark):
    """A large group in which no copy is near all others, and short texts that share most of a passage."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        w = base[:]
        for _ in range(4):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:12] + [f"y{r.randrange(10**6)}" for _ in range(r.randrange(6))]) for _ in range(60)]
    check(spark, list(enumerate(texts)))


def test_crowds_within_crowds(spark):
    """A cloud of near copies at all distances from its centre, and texts of a common passage with a second one in some of them."""
    r = random.Random(4)
    base, second = [f"w{i}" for i in range(90)], [f"v{i}" for i in range(30)]
    texts = []
    for _ in range(160):
        w = base[:]
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[r.randrange(90)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    for _ in range(120):
        own = [f"y{r.randrange(10**6)}" for _ in range(r.randrange(4, 22))]
        texts.append(" ".join(base[:40] + (second if r.random() < 0.5 else []) + own))
    r.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark, odd_docs, no_docs):
    assert parity_join.join(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(90, "THE quick brown FOX. jumps OVER the\tlazy dog, 12 times!"), (91, "Über straße x y"), (92, "über straße x y"), (93, "a"), (94, "A")]
    check(spark, rows)


def test_rows_without_an_own_id(spark):
    """A null row that alone links two others, and a doc_id that two different texts have."""
    base = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    rows = [(1, edit(0, 12)), (None, edit(0)), (2, edit(0, 40))]
    assert linked(shingles(rows[0][1]), shingles(rows[1][1])) and linked(shingles(rows[1][1]), shingles(rows[2][1])) and not linked(shingles(rows[0][1]), shingles(rows[2][1]))
    check(spark, rows)
    kept = parity_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [1]
    other = [f"y{i}" for i in range(60)]
    twice = [(7, " ".join(base)), (7, " ".join(other)), (8, edit(5)), (9, " ".join(["z", *other[1:]])), (10, edit(5, 30))]
    check(spark, twice)


def test_every_pair_of_linked_sets_shares_a_key():
    r = np.random.default_rng(1)
    for _ in range(400):
        n = int(r.choice([1, 2, 3, 4, 5, 7, 10, 20, 50, 200, 900]))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        while True:
            more = np.unique(np.append(b, r.integers(0, 2**63, 1).astype(np.uint64))) if r.random() < 0.5 else np.delete(b, r.integers(0, max(1, len(b))))
            same = len(np.intersect1d(a, more))
            if not len(more) or 100 * same < 75 * (len(a) + len(more) - same):
                break
            b = more
        key, of, _ = parity_join.sketch_keys([a, b])
        shared = set(key[of == 0].tolist()) & set(key[of == 1].tolist())
        assert len(shared) > parity_join.spare(np.array([min(len(a), len(b))]))[0]


def test_hamming_bounds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 500, 300).astype(np.uint64)) for _ in range(2))
        apart = sum(bin(x ^ y).count("1") for x, y in zip(parity_join.dense(a), parity_join.dense(b)))
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    r = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200 + r.randrange(60), 200 + r.randrange(60)) for _ in range(45)]
    got = {x.v: x.root for x in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    group = {v: v for p in pairs for v in p}
    for _ in range(300):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    for a, b in pairs:
        assert a == b or got[a] == got[b]
    assert len(set(got.values())) == len({group[v] for v in got})
