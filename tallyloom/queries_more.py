"""Registered queries: further forecasters, comparisons and tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .operators import inventory, splits, statistics
from .plans.bindings import KEYS, demand_panel, given_orders, state
from .queries_models import _LEDGER_SQL, _PMF_SQL, FOLD, _ledger, _pmf
from .queries_selection import _BEST_SQL, _PER_SQL, _per, _picks
from .registry import query

BY = "PARTITION BY store, product ORDER BY week_idx"


@query(f""", x AS (SELECT *, lag(demand) OVER ({BY}) l1, avg(demand) OVER ({BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) m13 FROM panel), t AS (SELECT store, product, week_idx, l1, m13 FROM x WHERE week_idx = 350), h AS (SELECT store, product, week_idx w, demand, l1, m13 FROM x WHERE week_idx BETWEEN 53 AND 349),
n AS (SELECT t.store, t.product, h.demand, row_number() OVER (PARTITION BY t.store, t.product ORDER BY round(power(t.l1 - h.l1, 2) + power(t.m13 - h.m13, 2), 6), w) rn FROM t JOIN h ON t.store = h.store AND t.product = h.product)
SELECT store, product, tau, round(quantile_cont(demand, 0.1), 6) AS value FROM n, (SELECT 0.1::DOUBLE tau) WHERE rn <= 50 GROUP BY ALL UNION ALL SELECT store, product, tau, round(quantile_cont(demand, 0.9), 6) FROM n, (SELECT 0.9::DOUBLE tau) WHERE rn <= 50 GROUP BY ALL""")
def f6_neighbour_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the demand that followed the fifty weeks of the same series whose features are nearest."""
    rows = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", "demand", F.lag("demand").over(X.ordered()).alias("l1"), F.avg("demand").over(X.ordered().rowsBetween(-13, -1)).alias("m13"))
    now = rows.where("week_idx = 350").select(*KEYS, F.col("l1").alias("t1"), F.col("m13").alias("t13"))
    past = rows.where("week_idx between 53 and 349").join(now, KEYS)
    distance = F.round((F.col("t1") - F.col("l1")) ** 2 + (F.col("t13") - F.col("m13")) ** 2, 6)
    near = past.withColumn("rn", F.row_number().over(Window.partitionBy(*KEYS).orderBy(distance, "week_idx"))).where("rn <= 50")
    q = near.groupBy(*KEYS).agg(F.percentile("demand", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    pairs = F.explode(F.arrays_zip(F.array(F.lit(0.1), F.lit(0.9)).alias("tau"), F.col("q").alias("value"))).alias("p")
    return q.select(*KEYS, pairs).select(*KEYS, "p.tau", F.round("p.value", 6).alias("value"))


@query(""", s AS (SELECT store, product, avg(demand) m, var_pop(demand) v, avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) z FROM panel GROUP BY ALL) SELECT store, product, round(greatest(0, (v - m) / (v - m + m * m)), 6) extra_zeros, round(m / (1 - greatest(0, (v - m) / (v - m + m * m))), 6) rate FROM s WHERE m > 0""")
def f15_zero_inflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-inflated Poisson by moments: the share of extra zeros and the rate of the rest."""
    m, v = F.col("m"), F.col("v")
    pi = F.greatest(F.lit(0.0), (v - m) / (v - m + m * m))
    s = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg("demand").alias("m"), F.var_pop("demand").alias("v")).where("m > 0")
    return s.select(*KEYS, F.round(pi, 6).alias("extra_zeros"), F.round(m / (1 - pi), 6).alias("rate"))


@query(_PMF_SQL + """, c2 AS (SELECT a.store, a.product, a.x + b.x AS x, sum(a.p * b.p) p FROM pmf a JOIN pmf b ON a.store = b.store AND a.product = b.product GROUP BY a.store, a.product, a.x + b.x),
l1 AS (SELECT s.store, s.product, greatest(CAST(on_hand AS INTEGER) - x, 0) + CAST(intransit_1 AS INTEGER) AS x, sum(p) p FROM state s JOIN pmf ON s.store = pmf.store AND s.product = pmf.product GROUP BY ALL),
l2 AS (SELECT l.store, l.product, greatest(l.x - d.x, 0) + CAST(intransit_2 AS INTEGER) AS x, sum(l.p * d.p) p FROM l1 l JOIN pmf d ON l.store = d.store AND l.product = d.product JOIN state s ON s.store = l.store AND s.product = l.product GROUP BY ALL),
nt AS (SELECT d.store, d.product, d.x - l.x AS x, sum(d.p * l.p) p FROM pmf d JOIN l2 l ON d.store = l.store AND d.product = l.product GROUP BY d.store, d.product, d.x - l.x), cf AS (SELECT *, sum(p) OVER (PARTITION BY store, product ORDER BY x) cdf FROM nt)
SELECT store, product, greatest(min(x), 0) order_qty FROM cf WHERE cdf >= 1.0 / 1.2 - 1e-9 GROUP BY ALL""")
def g5_three_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two periods of leftovers with shipments arriving between, then the critical fractile of the third."""
    pmf, s = _pmf(spark, sf_dir), state(demand_panel(spark, sf_dir))
    stock = s.select(*KEYS, F.col("on_hand").cast("int").alias("x"), F.lit(1.0).alias("p"))
    for slot in ("intransit_1", "intransit_2"):
        arriving = s.select(*KEYS, F.col(slot).cast("int").alias("x"), F.lit(1.0).alias("p"))
        stock = inventory.convolve(inventory.leftover(pmf, stock, KEYS), arriving, KEYS)
    net = inventory.convolve(pmf, stock, KEYS, F.col("xa") - F.col("xb"))
    return inventory.fractile(net, KEYS, 1.0 / 1.2).select(*KEYS, F.greatest(F.col("x"), F.lit(0)).alias("order_qty"))


@query(_LEDGER_SQL + ", b AS (SELECT store, sum(holding_cost + shortage_cost) AS cost, stddev_samp(holding_cost + shortage_cost) sd FROM ledger GROUP BY store, product) SELECT store, round(sum(cost), 4) AS cost, round(sqrt(sum(sd * sd)), 5) sd FROM b GROUP BY store")
def g15_portfolio_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of series' costs and the root of their summed variances."""
    c = F.col("holding_cost") + F.col("shortage_cost")
    b = _ledger(spark, sf_dir).groupBy(*KEYS).agg(F.sum(c).alias("cost"), F.stddev_samp(c).alias("sd"))
    return b.groupBy("store").agg(F.round(F.sum("cost"), 4).alias("cost"), F.round(F.sqrt(F.sum(F.col("sd") ** 2)), 5).alias("sd"))


def _two_leads(lead: int) -> str:
    return _LEDGER_SQL.replace("lag(order_qty, 2)", f"lag(order_qty, {lead})").replace(", a AS", f", a{lead} AS").replace("FROM a)", f"FROM a{lead})").replace(" c AS (", f" c{lead} AS (").replace("\nc AS (", f"\nc{lead} AS (").replace("FROM c)", f"FROM c{lead})").replace(" l AS (", f" l{lead} AS (").replace("FROM l)", f"FROM l{lead})").replace("\nled AS", f"\nled{lead} AS").replace("FROM led)", f"FROM led{lead})").replace("\nledger AS", f"\nledger{lead} AS")


@query(_two_leads(2) + _two_leads(3) + " SELECT a.week_idx, round(sum(a.holding_cost + a.shortage_cost), 2) two_weeks, round(sum(b.holding_cost + b.shortage_cost), 2) three_weeks, round(sum(b.holding_cost + b.shortage_cost) - sum(a.holding_cost + a.shortage_cost), 2) delta FROM ledger2 a JOIN ledger3 b USING (store, product, week_idx) GROUP BY ALL")
def h15_lead_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly costs of the same orders arriving after two and after three weeks."""
    panel = demand_panel(spark, sf_dir)
    cost = F.sum(F.col("holding_cost") + F.col("shortage_cost"))
    by = {n: inventory.ledger(panel, state(panel), given_orders(panel), lead).groupBy("week_idx").agg(cost.alias(n)) for lead, n in ((2, "two_weeks"), (3, "three_weeks"))}
    rows = by["two_weeks"].join(by["three_weeks"], "week_idx")
    return rows.select("week_idx", F.round("two_weeks", 2).alias("two_weeks"), F.round("three_weeks", 2).alias("three_weeks"), F.round(F.col("three_weeks") - F.col("two_weeks"), 2).alias("delta"))


@query(f""", f AS (SELECT store, product, week_idx, demand y, lag(demand) OVER ({BY}) naive, avg(demand) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) model FROM panel), s AS (SELECT store, product, count(model) / count(*)::DOUBLE coverage, sqrt(avg(power(y - model, 2))) rmse, avg(abs(y - model)) mae, avg(abs(y - naive)) scale FROM f WHERE week_idx >= 340 AND (week_idx + product) % 7 <> 0 GROUP BY ALL)
SELECT store, product, round(coverage, 6) coverage, round(rmse, 6) rmse, round(mae, 6) mae, round(mae / nullif(scale, 0), 6) mase, CAST(rank() OVER (ORDER BY round(mae, 6)) AS INTEGER) AS rank FROM s""")
def i21_external_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied forecasts scored on a hold-out against the last value, and ranked (a row per series)."""
    rows = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.col("demand").alias("y"), F.lag("demand").over(X.ordered()).alias("naive"), F.avg("demand").over(X.ordered().rowsBetween(-4, -1)).alias("model"))
    e = F.col("y") - F.col("model")
    s = rows.where("week_idx >= 340 and (week_idx + product) % 7 <> 0").groupBy(*KEYS).agg((F.count("model") / F.count("*")).alias("coverage"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(F.col("y") - F.col("naive"))).alias("scale"))
    return s.select(*KEYS, *(F.round(c, 6).alias(c) for c in ("coverage", "rmse", "mae")), F.round(F.try_divide("mae", "scale"), 6).alias("mase"), F.rank().over(Window.orderBy(F.round("mae", 6))).alias("rank"))


@query(_BEST_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY round(c, 9), model) r FROM m) SELECT p.store, p.product, p.fold_idx, arg_min(p.model, r) AS model FROM per p JOIN rk ON p.store = rk.store AND p.product = rk.product AND p.model = rk.model WHERE NOT (p.model = 'mean' AND p.fold_idx % 3 = 0) GROUP BY p.store, p.product, p.fold_idx")
def j8_ranked_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-ranked model that has each fold (one model lacks every third)."""
    m = _picks(spark, sf_dir)[0]
    ranked = m.select("model", *KEYS, F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.round("c", 9), "model")).alias("r"))
    have = _per(spark, sf_dir).where("not (model = 'mean' and fold_idx % 3 = 0)").select("model", *FOLD).distinct()
    return have.join(ranked, ["model", *KEYS]).groupBy(*FOLD).agg(F.min_by("model", "r").alias("model"))


@query(_PER_SQL + ", b AS (SELECT model, store, product, fold_idx, step, CASE WHEN error < -5 THEN -1 WHEN error > 5 THEN 1 ELSE 0 END k FROM per), c AS (SELECT a.k x, b.k y, count(*) c FROM b a JOIN b USING (store, product, fold_idx, step) WHERE a.model < b.model GROUP BY ALL), t AS (SELECT *, sum(c) OVER () n, sum(c) OVER (PARTITION BY x) nx, sum(c) OVER (PARTITION BY y) ny FROM c) SELECT 'mean' AS a, 'seasonal' AS b, round(sum(c / n * ln(c * n / (nx * ny))), 6) mi FROM t")
def l6_model_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of two models' binned errors."""
    k = F.when(F.col("error") < -5, -1).when(F.col("error") > 5, 1).otherwise(0)
    rows = _per(spark, sf_dir).select("model", *FOLD, "step", k.alias("k"))
    a, b = rows.select(F.col("model").alias("a"), *FOLD, "step", F.col("k").alias("x")), rows.select(F.col("model").alias("b"), *FOLD, "step", F.col("k").alias("y"))
    return statistics.mutual_information(a.join(b, [*FOLD, "step"]).where("a < b"), ["a", "b"], "x", "y").withColumn("mi", F.round("mi", 6))


@query(_PER_SQL + ", d AS (SELECT model, week_idx % 13 k, error FROM per JOIN test USING (store, product, fold_idx, step)) SELECT model, CAST(k AS INTEGER) phase, round(avg(error), 6) bias, count(*) n FROM d GROUP BY ALL")
def i11_bias_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = splits.rolling_origin(demand_panel(spark, sf_dir)).where("role = 'test'").select(*FOLD, "step", "week_idx")
    rows = _per(spark, sf_dir).join(weeks, [*FOLD, "step"])
    return rows.groupBy("model", (F.col("week_idx") % 13).alias("phase")).agg(F.round(F.avg("error"), 6).alias("bias"), F.count("*").alias("n"))


@query(", d AS (SELECT store, product, week_idx, demand, demand - avg(demand) OVER (PARTITION BY store, product) e FROM panel), p AS (SELECT store, product, sum(e) OVER (PARTITION BY store, product ORDER BY week_idx) s, e, lag(e) OVER (PARTITION BY store, product ORDER BY week_idx) e1, count(*) OVER (PARTITION BY store, product) n FROM d) SELECT store, product, round(sum(s * s) / (any_value(n) * (sum(e * e) + 2 * 0.5 * sum(e * e1))), 6) stat FROM p GROUP BY ALL")
def k6_kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level stationarity: partial sums against a long-run variance with one lag."""
    d = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", (F.col("demand") - F.avg("demand").over(Window.partitionBy(*KEYS))).alias("e"))
    p = d.select(*KEYS, "e", F.sum("e").over(X.ordered()).alias("s"), F.lag("e").over(X.ordered()).alias("e1"))
    long_run = F.sum(F.col("e") ** 2) + 2 * 0.5 * F.sum(F.col("e") * F.col("e1"))
    return p.groupBy(*KEYS).agg(F.round(F.sum(F.col("s") ** 2) / (F.count("*") * long_run), 6).alias("stat"))


@query(_PMF_SQL + ", m AS (SELECT store, product, count(*) n, avg(demand) mu, var_samp(demand) v, avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) z FROM panel GROUP BY ALL) SELECT store, product, round(v / mu, 6) dispersion, round((z - exp(-mu)) / sqrt(exp(-mu) * (1 - exp(-mu)) / n), 3) zero_excess FROM m WHERE mu > 0")
def k11_count_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion against a Poisson distribution and the normal deviate of its zeros."""
    m = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("demand").alias("mu"), F.var_samp("demand").alias("v"), F.avg((F.col("demand") == 0).cast("double")).alias("z")).where("mu > 0")
    p0 = F.exp(-F.col("mu"))
    return m.select(*KEYS, F.round(F.col("v") / F.col("mu"), 6).alias("dispersion"), F.round((F.col("z") - p0) / F.sqrt(p0 * (1 - p0) / F.col("n")), 3).alias("zero_excess"))
