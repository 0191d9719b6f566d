"""Bins, information, partial autocorrelations and serial tests against plain numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyloom.operators import information as I
from tallyloom.operators import resampling as R


def plain_bins(values, bins=8):
    edges = np.unique(np.percentile(values, np.linspace(0, 100, bins + 1)))
    if len(edges) < 3:
        ranks = pd.Series(values).rank(method="average").to_numpy()
        return np.digitize(ranks, np.linspace(0, ranks.max() + 1, bins + 1)) - 1
    return np.digitize(values, edges) - 1


def plain_bits(x, y):
    p = pd.crosstab(x, y).to_numpy() / len(x)
    q = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log2(p[p > 0] / q[p > 0])).sum())


def test_bins_and_information(spark):
    r = np.random.default_rng(6)
    kinds = {"counts": r.poisson(3, 200), "flag": r.integers(0, 2, 200), "same": np.full(200, 4), "wide": r.integers(0, 1000, 200), "ends": np.repeat([0, 9], 100)}
    rows = [(1, k, i, float(v)) for k, own in kinds.items() for i, v in enumerate(own)]
    got = I.binned(spark.createDataFrame(rows, "g int, feature string, i int, v double"), ["g"], "feature", "v")
    table = got.toPandas()
    for k, own in kinds.items():
        bins = table[table.feature == k].sort_values("i").bin.tolist()
        assert plain_bits(np.array(bins), plain_bins(own)) == plain_bits(plain_bins(own), plain_bins(own)), k
        assert bins == plain_bins(own).tolist(), k
    x1, x2, y = (plain_bins(kinds[k]) for k in ("counts", "flag", "wide"))
    wide = spark.createDataFrame([(1, int(a), int(b), int(c)) for a, b, c in zip(x1, x2, y)], "g int, a int, b int, y int")
    d = I.decomposed(wide, ["g"], "a", "b", "y").first()
    i1, i2, both = plain_bits(x1, y), plain_bits(x2, y), plain_bits(x1 * 100 + x2, y)
    red = min(i1, i2)
    want = [i1, i2, both, red, max(0, i1 - red), max(0, i2 - red), max(0, both - max(i1, i2))]
    assert np.allclose([d.mi_x1_y, d.mi_x2_y, d.mi_x1x2_y, d.redundancy, d.unique_x1, d.unique_x2, d.synergy], want)


def test_partial_autocorrelations_solve_the_equations(spark):
    """The k-th is the last coefficient of the Yule-Walker equations of order k."""
    r = np.random.default_rng(8)
    y = np.convolve(r.standard_normal(300), [1, 0.6, -0.3])[:300]
    d = y - y.mean()
    acf = np.array([(d[k:] * d[: len(d) - k]).sum() / (d * d).sum() for k in range(1, 16)])
    got = spark.createDataFrame([([float(x) for x in acf],)], "acf array<double>").select(I.partial_autocorrelation(F.col("acf")).alias("p")).first().p
    full = np.concatenate([[1.0], acf])
    want = [np.linalg.solve(np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)]), full[1 : k + 1])[-1] for k in range(1, 16)]
    assert np.allclose(got, want)


def test_changing_variance(spark):
    r = np.random.default_rng(4)
    calm = r.normal(10, 1, 120)
    noisy = np.zeros(120)
    for t in range(1, 120):
        noisy[t] = r.normal() * np.sqrt(0.3 + 0.8 * noisy[t - 1] ** 2)
    rows = [(k, w, float(v)) for k, own in enumerate((calm, noisy, np.full(120, 3.0), calm[:10])) for w, v in enumerate(own)]
    got = {x.g: x for x in I.changing_variance(spark.createDataFrame(rows, "g int, week_idx int, demand double"), ["g"]).collect()}
    for k, y in ((0, calm), (1, noisy)):
        e = (y - y.mean()) ** 2
        x = pd.DataFrame({i: pd.Series(e).shift(i) for i in range(1, 13)}).assign(one=1.0).iloc[12:].to_numpy()
        t = e[12:]
        fitted = x @ np.linalg.pinv(x) @ t
        assert abs(got[k].lm - len(t) * (1 - ((t - fitted) ** 2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-6
    assert got[1].lm > got[0].lm and got[2].lm is None and got[3].lm is None and got[3].lags == 2


def test_bootstrap_weights_are_poisson(spark):
    rows = spark.createDataFrame([(s, p, w) for s in range(3) for p in range(4) for w in range(50)], "store int, product int, week_idx int")
    w = R.weights(rows, 60).toPandas()
    assert len(w) == 600 * 60 and abs(w.w.mean() - 1) < 0.02 and abs(w.w.var() - 1) < 0.05
    per = w.groupby("replicate").w.sum()
    assert 15 < per.std() < 36  # the root of 600 is 24
    assert abs(np.corrcoef(w[w.replicate == 0].sort_values(["store", "product", "week_idx"]).w, w[w.replicate == 1].sort_values(["store", "product", "week_idx"]).w)[0, 1]) < 0.15


def test_stock_aware_shares(spark):
    rows = [(1, 0.0, True), (1, 4.0, True), (1, 6.0, True), (1, 0.0, False), (1, 2.0, False), (2, 1.0, False), (2, 3.0, False), (3, 0.0, True), (3, 5.0, False)]
    got = {(x.g, x.y): round(x.share, 9) for x in R.stock_aware(spark.createDataFrame(rows, "g int, y double, in_stock boolean"), ["g"]).collect()}
    assert got == {(1, 0.0): 0.2, (1, 4.0): 0.4, (1, 6.0): 0.4, (2, 1.0): 0.5, (2, 3.0): 0.5, (3, 0.0): 1.0}
