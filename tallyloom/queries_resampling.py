"""Registered queries: bootstrap bands and forecasts by resampling, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import resampling as R
from .plans.bindings import KEYS, demand_panel
from .registry import query

_LEVELS = "[0.01,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]"
_BY = "PARTITION BY store, product ORDER BY week_idx"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.round("value", 6))


@query(f""", d AS (SELECT *, {' + '.join(f'CASE WHEN u >= {p} THEN 1 ELSE 0 END' for p in R.POISSON)} w FROM (SELECT *, {R.MIXED[3]} u FROM (SELECT *, {R.MIXED[2]} c FROM (SELECT *, {R.MIXED[1]} b FROM (SELECT *, {R.MIXED[0]} a FROM (
  SELECT store::BIGINT store, product::BIGINT product, week_idx::BIGINT week_idx, week, demand, CAST(in_stock AS INTEGER) flag, replicate FROM panel, (SELECT unnest(range(200)) replicate))))))),
g AS (SELECT replicate, kind, v AS value, sum(w) n, sum(w * demand) s, sum(w * demand * demand) q FROM (SELECT *, unnest(['overall', 'in_stock', 'year', 'iso_week']) kind, unnest([0, flag, CAST(year(week) AS INTEGER), CAST(weekofyear(week) AS INTEGER)]) v FROM d WHERE w > 0) GROUP BY ALL),
m AS (SELECT kind, value, s / n m FROM g UNION ALL SELECT 'overall_sd', value, sqrt((q - s * s / n) / (n - 1)) FROM g WHERE kind = 'overall')
SELECT kind, CAST(value AS INTEGER) AS value, round(avg(m), 5) mean, round(stddev_samp(m), 5) sd, round(quantile_cont(m, 0.025), 5) low, round(quantile_cont(m, 0.975), 5) high FROM m GROUP BY ALL""")
def e11_bootstrap_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of mean demand overall, by stock flag, year and ISO week over 200 row-preserving replicates."""
    return R.bootstrap_bands(demand_panel(spark, sf_dir)).select("kind", "value", *(F.round(c, 5).alias(c) for c in ("mean", "sd", "low", "high")))


@query(f""", h AS (SELECT store, product, week_idx, list(demand) OVER ({_BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) pr, list(demand) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) nx, row_number() OVER ({_BY}) rn, count(*) OVER (PARTITION BY store, product) n FROM panel),
t AS (SELECT store, product, list(demand ORDER BY week_idx) now FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) <= 13) GROUP BY ALL),
k AS (SELECT store, product, nx, row_number() OVER (PARTITION BY store, product ORDER BY round(list_sum([(pr[i] - now[i]) * (pr[i] - now[i]) FOR i IN range(1, 14)]), 6), week_idx) place FROM h JOIN t USING (store, product) WHERE len(pr) = 13 AND rn <= n - 2),
q AS (SELECT store, product, i AS step, quantile_cont(greatest(nx[i], 0.0), {_LEVELS}) q FROM k, (SELECT unnest([1, 2]) i) WHERE place <= 20 GROUP BY ALL)
SELECT store, product, CAST(step AS INTEGER) step, unnest({_LEVELS}) tau, round(unnest(q), 6) AS value FROM q""")
def f5_like_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the two weeks after the twenty stretches of a series' history that are most like its last thirteen weeks."""
    return _rounded(R.like_profiles(demand_panel(spark, sf_dir)))


_LIKE_SQL = f""", x AS (SELECT *, lag(demand) OVER ({_BY}) l1, avg(demand) OVER ({_BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) m13, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) age FROM panel),
n AS (SELECT h.store, h.product, h.demand y, h.in_stock, row_number() OVER (PARTITION BY h.store, h.product ORDER BY round(power(t.l1 - h.l1, 2) + power(t.m13 - h.m13, 2), 6), h.week_idx) place FROM x t JOIN x h ON t.store = h.store AND t.product = h.product AND t.age = 1 AND h.age > 1 AND h.l1 IS NOT NULL)"""


@query(_LIKE_SQL + f" SELECT store, product, unnest({_LEVELS}) tau, round(unnest(q), 6) AS value FROM (SELECT store, product, quantile_cont(y, {_LEVELS}) q FROM n WHERE place <= 50 GROUP BY ALL)")
def f6_conditional_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of what sold in the fifty weeks most like the last, at all levels."""
    near = R.like_weeks(demand_panel(spark, sf_dir)).groupBy(*KEYS).agg(F.percentile("y", _levels()).alias("q"))
    return _rounded(R.long_quantiles(near, KEYS, "q"))


def _levels() -> Column:
    return F.array(*map(F.lit, R.LEVELS))


@query(_LIKE_SQL + f""", c AS (SELECT *, count(*) OVER p n_all, count_if(in_stock) OVER p n_in, count_if(in_stock AND y > 0) OVER p n_pos FROM n WHERE place <= 50 WINDOW p AS (PARTITION BY store, product)),
w AS (SELECT store, product, y, sum(CASE WHEN n_in = 0 THEN 1.0 / n_all ELSE (1 + CASE WHEN n_pos > 0 THEN CASE WHEN in_stock AND y > 0 THEN (n_all - n_in) / n_pos ELSE 0 END ELSE (n_all - n_in) / n_in END) / n_all END) w FROM c WHERE in_stock OR n_in = 0 GROUP BY ALL),
f AS (SELECT *, sum(w) OVER (PARTITION BY store, product ORDER BY y) / sum(w) OVER (PARTITION BY store, product) cdf FROM w)
SELECT store, product, tau, round(min(y), 6) AS value FROM f, (SELECT unnest({_LEVELS}) tau) WHERE cdf >= tau - 1e-9 GROUP BY ALL""")
def f7_stock_aware_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of stock-outs moved to weeks in stock that sold something."""
    return _rounded(R.weighted_quantiles(R.stock_aware(R.like_weeks(demand_panel(spark, sf_dir)), KEYS), KEYS))
