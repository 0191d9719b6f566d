"""Sums that decide between two sides don't depend on the order of rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tallyloom import registry

registry.load()


def test_half_of_the_weeks_is_not_more_than_half(spark, tmp_path):
    """104 weeks of which 52 are above the stock, on many different values."""
    r, rows = np.random.default_rng(5), []
    for product in range(40):
        stock = 3 * product % 60
        late = np.concatenate([r.integers(0, stock + 1, 52), r.integers(stock + 1, stock + 30, 52)])
        for week, x in enumerate(np.concatenate([np.ones(253), r.permutation(late)])):
            rows.append((product * 100 + 1, 5, float(x), dt.datetime(1995, 1, 2) + dt.timedelta(weeks=week)))
    pd.DataFrame(rows, columns=["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]).to_parquet(f"{tmp_path}/lineitem.parquet", coerce_timestamps="us")
    got = registry.QUERIES["i13_stockout_probability"](spark, str(tmp_path)).toPandas()
    assert len(got) == 40 and (got.p_stockout == 0.5).all() and (got.flagged == 0).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_orders_cost_the_same_in_any_order_of_rows(spark, tmp_path, seed):
    prices = [0.1, 0.2, 0.3, 75462.67, 372772.98, 1001.91]
    orders = [(c * 10 + i, c, x, dt.datetime(1996, 5, 1)) for c in range(40) for i, x in enumerate(prices)]
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]).sample(frac=1, random_state=seed).to_parquet(f"{tmp_path}/orders.parquet", coerce_timestamps="us")
    pd.DataFrame([(c, f"Customer#{c:09d}") for c in range(40)], columns=["c_custkey", "c_name"]).to_parquet(f"{tmp_path}/customer.parquet")
    got = registry.QUERIES["a19_leaderboard_text"](spark, str(tmp_path)).toPandas().sort_values("rank")
    assert got.name.tolist() == sorted(got.name) and got["rank"].tolist() == list(range(1, 41)) and (got.order_cost == round(sum(prices), 2)).all()
