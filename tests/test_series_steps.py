"""Steps worked out a series (or a forecast) at a time give what the long forms give, and neither rank nor multiply rows."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tallyloom.functions import features as X
from tallyloom.operators import evaluation, inventory, statistics
from tallyloom.operators import information as I
from tallyloom.operators import learned as L
from tallyloom.operators import resampling as R
from tallyloom.operators.forecasts import LEVELS


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_second_week_keeps_its_numbers_in_a_forecasts_row(spark):
    """Also forecasts of nothing, of falling quantiles, without a level, and of one step only (left out)."""
    r = np.random.default_rng(3)
    rows = [(k, f, s, t, float(v)) for k in range(6) for f in range(2) for s in (1, 2, 3) for t, v in zip(LEVELS, r.normal(4 * k, 3, len(LEVELS)) if k else np.zeros(len(LEVELS)))]
    rows += [(7, 0, 1, t, 1.0) for t in LEVELS] + [(6, 0, s, t, v) for s in (1, 2) for t, v in ((0.2, 3.0), (0.8, None))]
    frame = spark.createDataFrame(rows, "product int, fold_idx int, step int, tau double, value double")
    state = spark.createDataFrame([(k, 5.0 * (k % 3), 2.0 * k, 1.0) for k in range(8)], "product int, on_hand double, intransit_1 double, intransit_2 double")
    keys = ["product", "fold_idx"]
    out = evaluation.second_week_orders(frame, state, keys, ["product"])
    text = plan(out)
    assert "Generate" not in text and "Window" not in text
    want = evaluation.second_week(inventory.quantiles_to_pmf(frame.where("step <= 2"), [*keys, "step"]), state, keys, ["product"])
    a, b = (d.orderBy(*keys).toPandas() for d in (out, want))
    assert len(a) == 13 and (a[[*keys, "order_qty"]] == b[[*keys, "order_qty"]]).all().all() and np.allclose(a.expected_cost, b.expected_cost)


def test_bits_of_a_series_without_ranks_and_joins(spark):
    r = np.random.default_rng(5)
    rows = [(g, i, float(r.poisson(5 + g)), float(r.poisson(4)), float(i % 2)) for g in range(3) for i in range(80)] + [(9, i, 1.0, 1.0, 1.0) for i in range(15)] + [(8, i, 2.0, 2.0, 0.0) for i in range(16)]
    frame = spark.createDataFrame(rows, "g int, i int, y double, a double, b double")
    told = I.told(frame, ["g"], "y", ["a", "b"], ("a", "b"))
    assert "Window" not in plan(told) and "Join" not in plan(told)
    long = I.binned(frame.where("g != 9").unpivot(["g", "i"], ["y", "a", "b"], "feature", "v"), ["g"], "feature", "v")
    wide = long.groupBy("g", "i").agg(*(F.max(F.when(F.col("feature") == c, F.col("bin"))).alias(c) for c in ("y", "a", "b")))
    a, b = (d.orderBy("g").toPandas() for d in (I.parts_told(told, ["g"], "a", "b"), I.decomposed(wide, ["g"], "a", "b", "y")))
    assert list(a.columns) == list(b.columns) and len(a) == 4 and np.allclose(a, b)


def test_autocorrelations_shuffle_a_series_once(spark):
    r = np.random.default_rng(6)
    y = {0: r.poisson(4, 40).astype(float), 1: np.full(9, 3.0), 2: r.poisson(4, 5).astype(float)}
    frame = spark.createDataFrame([(k, i, float(v)) for k, own in y.items() for i, v in enumerate(own)], "k int, i int, v double").repartition(3)
    out = statistics.autocorrelations(frame, ["k"], "i", "v", 8)
    assert "Window" not in plan(out) and "Join" not in plan(out)
    got = {row.k: row for row in out.collect()}
    assert got[1].acf == [None] * 8 and got[2].acf[5:] == [None] * 3 and got[2].acf[4] is None
    d = y[0] - y[0].mean()
    assert got[0].n == 40 and np.allclose(got[0].acf, [d[k:] @ d[:-k] / (d @ d) for k in range(1, 9)])


def test_rolled_equals_windows(spark):
    """With unknown values, all unknown, and series shorter than a window."""
    r = np.random.default_rng(7)
    rows = [(0, p, i, None if r.random() < 0.2 or p == 3 else float(r.poisson(6))) for p, n in ((1, 60), (2, 3), (3, 5)) for i in range(n)]
    frame = spark.createDataFrame(rows, "store int, product int, week_idx int, v double").repartition(3)
    out = X.rolled(frame, "v")
    assert "Window" not in plan(out)
    a, b = (d.orderBy("product", "week_idx").toPandas() for d in (out, frame.select("*", *(c.alias(n) for n, c in X.rolling("v").items()))))
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_bootstrap_sums_make_no_row_per_replicate(spark):
    rows = spark.range(300).selectExpr("cast(id % 3 as int) store", "cast(id div 60 as int) product", "cast(id % 60 as int) week_idx", "cast(id % 7 as double) demand", "cast(id % 2 as int) flag", "cast(id % 5 as int) iso")
    out = R.cell_sums(rows, ["flag", "iso"], 20)
    assert "Generate" not in plan(out)
    w, y = F.col("w"), F.col("demand")
    want = R.weights(rows, 20).groupBy("replicate", "flag", "iso").agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"))
    got = out.groupBy("replicate", "flag", "iso").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    assert sorted(map(tuple, got.collect())) == sorted((int(r[0]), *r[1:]) for r in want.collect())


def test_learning_rows_are_dealt_to_all_cores(spark):
    rows = L.dealt(spark.range(400).selectExpr("cast(id % 5 as int) store", "cast(id div 5 as int) product").coalesce(1))
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # small parts aren't merged


def test_composite_works_series_out_side_by_side(spark):
    """Series of one, three and seventy weeks: no windows or sorts of rows, and what a series lacks is the exact lower median of all rows."""
    r = np.random.default_rng(9)
    rows = [(s, p, datetime.date(2021, 1, 4) + datetime.timedelta(weeks=i), i, float(r.poisson(20)), bool(r.random() > 0.1)) for s, p, n in ((0, 1, 70), (1, 1, 3), (0, 9, 70), (2, 9, 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "store int, product int, week date, week_idx int, demand double, in_stock boolean").repartition(3)
    out = X.composite(frame)
    assert "Window" not in plan(out) and "percentile" not in plan(out) and "Join" not in plan(out)
    got = out.orderBy("product", "store", "week_idx").toPandas()
    assert len(got) == len(rows) and list(got.columns[:6]) == frame.columns
    long = [g.y_scaled.to_numpy() for _, g in got.groupby(["store", "product"]) if len(g) == 70]
    for k in (51, 52, 53):  # only the long series have any
        known = np.sort(np.concatenate([v[:-k] for v in long]))
        known = known[~np.isnan(known)]
        assert (got[got.store > 0][f"lag_{k}"] == known[(len(known) + 1) // 2 - 1]).all()
    one = got[got.store == 2].iloc[0]
    assert one.scale_factor == 1.0 and one.sample_weight == 1.0 and one[list(X.COMPOSITE)].notna().all() and np.isnan(one.y_h1)


def test_composite_medians_within_a_range(spark):
    """Medians of values that share a range, of even and odd numbers, and of whole numbers."""
    values = np.array([4.0001, 4.0002, 4.0003, 4.0004, -2.0, 9.0, 0.0])
    places = X._place(values)
    assert (np.argsort(places) == np.argsort(values)).all() and X._place(np.array([-0.0])) == X._place(np.array([0.0])) and len(set(places[:4] >> 44)) == 1
    y = np.array([0.0005, 2.0015, -0.0005, 1.23449999, 1e300, 123456.0015, 0.125])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in y], "v double").select(F.round("v", 3)).collect()]
    assert X.rounded(y, 3).tolist() == want
