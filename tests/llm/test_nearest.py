"""Multiprobe search against brute force, and its odd cases."""

import numpy as np

from tallyloom.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            d = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q)
            out[q] = d[:k]
    return out


def test_recall_on_clusters_and_uniform(spark):
    r = np.random.default_rng(5)
    near = r.standard_normal((40, 12))
    x = np.concatenate([near[r.integers(0, 40, 900)] + 0.1 * r.standard_normal((900, 12)), r.standard_normal((600, 12))]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*row, 0, 0.5) for row in rows], SCHEMA)
    truth = brute(rows, set(range(0, 1500, 50)), 10)
    got = {}
    for row in nearest.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.score, row.vec_id))
        assert row.rank == len(got[row.query_id])
    hits = sum(len({i for _, i in truth[q]} & {i for _, i in got[q]}) for q in truth)
    assert hits >= 0.9 * 10 * len(truth)
    for q in truth:
        assert got[q] == sorted(got[q])
        exact = {i: d for d, i in brute(rows, {q}, 1500)[q]}
        assert all(abs(exact[i] - d) < 1e-12 for d, i in got[q])


def test_probes_come_best_first_and_reach_the_share():
    t = nearest.Tables(8, 1.0, 1, 3, 0.8, 0.97)
    place = np.array([0.1, -2.6, 5.5])
    got = t.probes(place)
    assert got[0] == t.key(np.floor(place).astype(np.int64)) or len(got) > 1
    assert len(set(got.tolist())) == len(got) > 20


def test_odd_vectors_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (50, [1.0, 0.0]), (51, [0.9, 0.1]), (51, [0.5, 0.5])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, None) for r in rows], SCHEMA)
    got = nearest.search(df, df.where("vec_id in (0, 1, 2, 3, 4, 5, 6, 7)"), block=16).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, i, 0.0) for i in (50, *range(100, 109))]
    few = df.where("vec_id in (0, 51)")
    assert [r.vec_id for r in nearest.search(few, few.where("vec_id = 0")).collect()] == [51]
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def test_queries_far_from_the_rest_are_filled(spark):
    """A dense cloud and a few vectors spread out far around it: all queries get their ten, the far ones by further rounds or by comparing all."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((970, 16)) * 0.1, r.standard_normal((30, 16)) * 8]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*row, 0, 0.5) for row in rows], SCHEMA)
    asked = {*range(0, 1000, 100), *range(970, 1000, 3)}
    truth, got = brute(rows, asked, 10), {}
    for row in nearest.search(df, df.where(f"vec_id in ({','.join(map(str, asked))})")).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(asked, 10)
    assert sum(len({i for _, i in truth[q]} & set(got[q])) for q in asked) >= 9 * len(asked)


def test_a_scan_compares_all(spark):
    r = np.random.default_rng(3)
    rows = [(i % 150, [float(a) for a in v]) for i, v in enumerate(r.standard_normal((300, 4)))]  # each vec_id twice
    df = nearest.valid(spark.createDataFrame([(*row, 0, 0.5) for row in rows], SCHEMA))
    some = df.where("vec_id = 7").limit(1).collect()
    got = [(x.vec_id, x.score) for x in nearest.scan(df.coalesce(1), some, 5).collect()]
    dist = {}
    for i, v in rows:
        if i != 7:
            dist[i] = min(dist.get(i, 9e9), float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(some[0].v)) ** 2).sum())))
    assert [(i, round(s, 9)) for i, s in got] == [(i, round(d, 9)) for d, i in sorted((d, i) for i, d in dist.items())[:5]]


def test_what_is_kept_of_a_group_is_its_results():
    """Memory for queries against one group of rows grows with their results, not with the pairs; results are those of plain comparison."""
    r = np.random.default_rng(4)
    x, v = r.standard_normal((4000, 8)), r.standard_normal((300, 8))
    x[100:140] = x[100]  # ties at the k-th place
    v[0] = x[100]
    ids = r.permutation(4000)
    ids[:30] = ids[30:60]  # some ids on two rows
    got = nearest.closest(ids, x, np.full(300, -1), v, 5)
    held = {id(a.base if a.base is not None else a): (a.base if a.base is not None else a).nbytes for o in got for a in o}
    assert sum(held.values()) <= 3 * 300 * 5 * 8 * 2
    for (_, near, score), w in zip(got, v):
        every = {}
        for i, d in zip(ids.tolist(), np.sqrt(((x - w) ** 2).sum(1)).tolist()):
            every[i] = min(every.get(i, np.inf), d)
        assert list(zip(score.tolist(), near.tolist())) == sorted((d, i) for i, d in every.items())[:5]
    far = nearest.closest(np.arange(3), np.array([[1e200, 0], [2e200, 0], [0, 1.0]]), np.array([9]), np.array([[0, 2.0]]), 2)
    assert far[0][1].tolist() == [2, 0]


def test_slices_of_queries_find_the_same(spark):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(a) for a in v], 0, 0.5) for i, v in enumerate(r.standard_normal((400, 6)).astype(np.float32))], SCHEMA)
    one, more = (sorted(map(tuple, nearest.search(df, df.where("vec_id % 10 = 0"), block=32, most=m).collect())) for m in (32768, 7))
    assert one == more and len(one) == 400
