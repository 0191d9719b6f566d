"""Rows are multiplied after they were shuffled, not before."""

import numpy as np

from tallyloom.operators import forecasts, learned, scoring, splits, statistics


def test_periods_multiply_a_series_after_its_shuffle(spark):
    r = np.random.default_rng(4)
    y = {k: r.poisson(9, 60).astype(float) for k in range(3)}
    frame = spark.createDataFrame([(k, i, float(v)) for k, own in y.items() for i, v in enumerate(own)] + [(1, 60, None)], "k int, i int, v double")
    out = statistics.periodogram(frame, ["k"], "i", "v", [4, 7, 13])
    for row in out.collect():
        turn = np.arange(60) * 2 * np.pi / row.period
        d = y[row.k] - y[row.k].mean()
        assert np.isclose(row.power, (d @ np.cos(turn)) ** 2 + (d @ np.sin(turn)) ** 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan.split("Generate")[0]


def test_count_quantiles_keep_their_numbers_in_the_row(spark):
    """No window, no sort, and rows dealt to all tasks."""
    out = learned.count_quantiles(spark.createDataFrame([(i, 4.0 + i, 2.0) for i in range(20)], "id int, mu double, size double"), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "REPARTITION_BY_NUM" in plan and out.count() == 260


def test_seasonal_index_ranks_no_whole_history(spark):
    rows = spark.range(200).selectExpr("0 store", "cast(id % 2 as int) product", "cast(id div 2 as int) week_idx", "date_add(date'2021-01-04', cast(7 * (id div 2) as int)) week", "cast(id % 7 as double) demand")
    train = splits.rolling_origin(rows, least=20).where("role = 'train'")
    plan = forecasts.seasonal_index(train)._jdf.queryExecution().executedPlan().toString()
    ranked = [line.split("row_number() windowspecdefinition(")[1] for line in plan.split("\n") if "row_number() windowspecdefinition(" in line]
    assert ranked and not any("fold_idx" in r.split("ASC")[0] for r in ranked)


def test_calibration_orders_no_whole_group(spark):
    r = np.random.default_rng(8)
    values = {g: np.concatenate([r.beta(2, 3, 400).round(2), [0.01] * 30, [0.99] * 20, r.random(50)]) for g in "ab"}
    out = scoring.distance_to_uniform(spark.createDataFrame([(g, float(v)) for g, own in values.items() for v in own], "g string, pit double"), ["g"])
    for row in out.collect():
        v, i = np.sort(values[row.g]), np.arange(1, 501)
        assert row.n == 500 and row.ks == np.max(np.maximum(i / 500 - v, v - (i - 1) / 500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number()" not in plan and "_part" in plan
