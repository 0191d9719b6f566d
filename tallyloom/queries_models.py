"""Registered queries: distributions, forecasters, orders, ledgers and scores, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import forecasts, inventory, scoring, splits
from .plans.bindings import KEYS, demand_panel, given_orders, state
from .registry import query

FOLD = [*KEYS, "fold_idx"]
_LEVELS = "[0.01,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]"
_FOLDS_SQL = """, rr AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_idx) rn, count(*) OVER (PARTITION BY store, product) n FROM panel),
folds AS (SELECT * FROM (SELECT rr.*, CAST(k AS INTEGER) fold_idx, n - (12 - k) - 2 AS cut FROM rr, (SELECT unnest(range(12)) k)) WHERE rn <= cut + 3 AND cut >= 52),
train AS (SELECT * FROM folds WHERE rn <= cut), test AS (SELECT store, product, fold_idx, CAST(rn - cut AS INTEGER) step, demand y, week_idx FROM folds WHERE rn > cut)"""
_NAIVE_SQL = f"""{_FOLDS_SQL}, res AS (SELECT *, demand - lag(demand, 52) OVER (PARTITION BY store, product, fold_idx ORDER BY week_idx) r FROM train),
rq AS (SELECT store, product, fold_idx, quantile_cont(r, {_LEVELS}) q FROM res GROUP BY ALL),
base AS (SELECT store, product, fold_idx, CAST(rn - cut + 52 AS INTEGER) step, demand base FROM train WHERE rn - cut + 52 BETWEEN 1 AND 3),
fq AS (SELECT store, product, fold_idx, step, unnest({_LEVELS}) tau, greatest(0.0, base + unnest(q)) AS value FROM base JOIN rq USING (store, product, fold_idx))"""
_MEAN_SQL = """, nm AS (SELECT store, product, fold_idx, avg(demand) mu FROM train WHERE rn > cut - 4 GROUP BY ALL),
zs AS (SELECT unnest([0.01,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]) tau, unnest([-2.326348,-1.644854,-1.281552,-0.841621,-0.524401,-0.253347,0,0.253347,0.524401,0.841621,1.281552,1.644854,2.326348]::DOUBLE[]) z),
fm AS (SELECT store, product, fold_idx, CAST(s AS INTEGER) step, tau, greatest(0.0, mu + z * sqrt(mu)) AS value FROM nm, zs, (SELECT unnest(range(1, 4)) s))"""


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = demand_panel(spark, sf_dir).withColumn("year_ago", F.lag("demand", 52).over(Window.partitionBy(*KEYS).orderBy("week_idx")))  # once, not in each fold
    rows = splits.rolling_origin(panel)
    return rows.where("role = 'train'"), rows.where("role = 'test'").select(*FOLD, "step", F.col("demand").alias("y"))


@query(_NAIVE_SQL + " SELECT store, product, fold_idx, step, tau, round(value, 6) AS value FROM fq")
def f1_seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.seasonal_naive(_train_test(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


@query(_FOLDS_SQL + _MEAN_SQL + " SELECT store, product, fold_idx, step, tau, round(value, 6) AS value FROM fm")
def f2_naive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.naive_mean(_train_test(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


@query(f""", r AS (SELECT store, product, avg(demand) mu FROM panel GROUP BY ALL), x AS (SELECT store, product, mu, x, sum(exp(x * ln(mu) - mu - lgamma(x + 1))) OVER (PARTITION BY store, product ORDER BY x) cdf FROM r, (SELECT unnest(range(0, (SELECT CAST(max(mu) * 3 + 100 AS BIGINT) FROM r))) x))
SELECT store, product, tau, CAST(count(*) FILTER (cdf < tau - 1e-12) AS DOUBLE) AS value FROM x, (SELECT unnest({_LEVELS}) tau) GROUP BY ALL""")
def f2_poisson_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.poisson_quantiles(demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg("demand").alias("mu")), KEYS)


@query(""", o AS (SELECT store, product, demand y, row_number() OVER (PARTITION BY store, product ORDER BY week_idx) rn FROM panel), s AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY rn) k, rn - coalesce(lag(rn) OVER (PARTITION BY store, product ORDER BY rn), 0) gap, count(*) OVER (PARTITION BY store, product) m FROM o WHERE y > 0),
w AS (SELECT *, CASE WHEN k = 1 THEN power(0.9, m - 1) ELSE 0.1 * power(0.9, m - k) END wt FROM s)
SELECT store, product, 0 AS fold_idx, round(sum(wt * y) / sum(wt * gap) * 0.95, 6) AS level FROM w GROUP BY ALL""")
def f3_croston(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("fold_idx", F.lit(0))
    return forecasts.croston(rows).withColumn("level", F.round("level", 6))


@query(""", o AS (SELECT store, product, demand y, row_number() OVER (PARTITION BY store, product ORDER BY week_idx) k, count(*) OVER (PARTITION BY store, product) m FROM panel)
SELECT store, product, 0 AS fold_idx, round(sum(CASE WHEN k = 1 THEN power(0.7, m - 1) ELSE 0.3 * power(0.7, m - k) END * y), 6) AS level FROM o GROUP BY ALL""")
def f16_smoothed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("fold_idx", F.lit(0))
    return forecasts.smoothed_level(rows).select(*FOLD, F.round("level", 6).alias("level"))


@query(_FOLDS_SQL + """, ix AS (SELECT fold_idx, weekofyear(week) iso, avg(demand) m FROM train GROUP BY ALL), ov AS (SELECT fold_idx, avg(demand) o FROM train GROUP BY ALL), f AS (SELECT fold_idx, iso, m / o factor FROM ix JOIN ov USING (fold_idx)),
l AS (SELECT store, product, t.fold_idx, avg(demand / greatest(factor, 1e-6)) AS level, max(week) AS lw FROM train t JOIN f ON f.fold_idx = t.fold_idx AND f.iso = weekofyear(t.week) WHERE rn > cut - 13 GROUP BY ALL)
SELECT store, product, l.fold_idx, CAST(s AS INTEGER) step, round(level * factor, 6) AS value FROM l, (SELECT unnest(range(1, 4)) s) JOIN f ON f.fold_idx = l.fold_idx AND f.iso = weekofyear(lw + CAST(7 * s AS INTEGER))""")
def f17_seasonal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.seasonal_index(_train_test(spark, sf_dir)[0]).withColumn("value", F.round("value", 6))


@query(_NAIVE_SQL + " SELECT store, product, fold_idx, CAST(s AS INTEGER) step, tau, round(value, 6) AS value FROM fq JOIN (SELECT 1 AS s, 1 AS step UNION ALL SELECT 2, 2 UNION ALL SELECT 3, 2) m USING (step) WHERE fold_idx = 0")
def f18_copied_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing third step takes the second's values."""
    rows = forecasts.seasonal_naive(_train_test(spark, sf_dir)[0].where("fold_idx = 0"))
    have = rows.where("step < 3")
    third = have.where("step = 2").withColumn("step", F.lit(3)).join(have.select(*FOLD, "step", "tau"), [*FOLD, "step", "tau"], "left_anti")
    return have.unionByName(third).select(*FOLD, "step", "tau", F.round("value", 6).alias("value"))


_PMF_SQL = ", pmf AS (SELECT store, product, x, count(*) / sum(count(*)) OVER (PARTITION BY store, product) p FROM (SELECT store, product, CAST(round_even(demand, 0) AS INTEGER) x FROM panel WHERE week_idx >= 253) GROUP BY store, product, x)"


def _pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.empirical_pmf(demand_panel(spark, sf_dir).where("week_idx >= 253"), KEYS)


@query("SELECT store, product, week_idx, CASE WHEN ((store * 31 + product * 17 + week_idx) % 100) / 100.0 > 0.06 THEN 0.0 ELSE 50000.0 END::DOUBLE loss FROM panel")
def e1_threshold_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.pmod(F.col("store") * 31 + F.col("product") * 17 + F.col("week_idx"), F.lit(100)) / 100.0
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.when(u > 0.06, 0.0).otherwise(50000.0).alias("loss"))


@query(", s AS (SELECT store, week_idx scenario_id, sum(demand) v FROM panel GROUP BY ALL) SELECT CAST(scenario_id AS BIGINT) scenario_id, " + ", ".join(f"max(v) FILTER (store = {i}) store_{i}" for i in range(5)) + " FROM s GROUP BY ALL")
def e2_scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).groupBy("week_idx", "store").agg(F.sum("demand").alias("v"))
    wide = rows.groupBy(F.col("week_idx").cast("long").alias("scenario_id")).pivot("store", list(range(5))).agg(F.first("v"))
    return wide.toDF("scenario_id", *(f"store_{i}" for i in range(5)))


@query(_PMF_SQL + " SELECT store, product, x, round(p, 9) p FROM pmf")
def e7_e8_empirical_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.normalised(_pmf(spark, sf_dir), KEYS).withColumn("p", F.round("p", 9))


@query(_PMF_SQL + " SELECT a.store, a.product, a.x + b.x AS x, round(sum(a.p * b.p), 9) p FROM pmf a JOIN pmf b USING (store, product) GROUP BY a.store, a.product, a.x + b.x")
def e9_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf = _pmf(spark, sf_dir)
    return inventory.convolve(pmf, pmf, KEYS).withColumn("p", F.round("p", 9))


@query(_PMF_SQL + ", c AS (SELECT *, sum(p) OVER (PARTITION BY store, product ORDER BY x) cdf FROM pmf) SELECT store, product, round(sum(x * p), 6) mean, round(sum(x * x * p) - sum(x * p) ** 2, 5) variance, min(x) FILTER (cdf >= 0.833 - 1e-9) fractile, round(sum(p * greatest(x - 25, 0)), 6) expected_over, round(sum(p * greatest(25 - x, 0)), 6) expected_under FROM c GROUP BY ALL")
def e10_pmf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf = _pmf(spark, sf_dir)
    x, p = F.col("x"), F.col("p")
    sums = pmf.groupBy(*KEYS).agg(F.round(F.sum(x * p), 6).alias("mean"), F.round(F.sum(x * x * p) - F.sum(x * p) ** 2, 5).alias("variance"), F.round(F.sum(p * F.greatest(x - 25, F.lit(0))), 6).alias("expected_over"), F.round(F.sum(p * F.greatest(25 - x, F.lit(0))), 6).alias("expected_under"))
    return sums.join(inventory.fractile(pmf, KEYS, 0.833).withColumnRenamed("x", "fractile"), KEYS)


_LEDGER_SQL = """, a AS (SELECT p.*, s.on_hand, CASE WHEN week_idx = 0 THEN intransit_1 WHEN week_idx = 1 THEN intransit_2 ELSE 0 END + coalesce(lag(order_qty, 2) OVER (PARTITION BY store, product ORDER BY week_idx), 0) arriving FROM panel p JOIN state s USING (store, product) JOIN orders_given USING (store, product, week_idx)),
c AS (SELECT *, on_hand + sum(arriving - demand) OVER (PARTITION BY store, product ORDER BY week_idx) c FROM a), l AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY store, product ORDER BY week_idx)) leftover FROM c),
led AS (SELECT store, product, week_idx, coalesce(lag(leftover) OVER (PARTITION BY store, product ORDER BY week_idx), on_hand) on_hand_start, arriving, demand, leftover FROM l),
ledger AS (SELECT *, least(on_hand_start + arriving, demand) sold, demand - least(on_hand_start + arriving, demand) shortage, leftover * 0.2 holding_cost, demand - least(on_hand_start + arriving, demand) shortage_cost FROM led)"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    return inventory.ledger(panel, state(panel), given_orders(panel))


@query(_LEDGER_SQL + " SELECT store, product, week_idx, on_hand_start, arriving::DOUBLE arriving, demand, sold, shortage, leftover, round(holding_cost, 6) holding_cost, shortage_cost FROM ledger")
def h1_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).withColumn("holding_cost", F.round("holding_cost", 6))


@query(""", z AS (SELECT p.*, s.on_hand + sum(CASE WHEN week_idx = 0 THEN intransit_1 WHEN week_idx = 1 THEN intransit_2 ELSE 0 END - demand) OVER (PARTITION BY store, product ORDER BY week_idx) c FROM panel p JOIN state s USING (store, product))
SELECT store, product, week_idx, c - least(0, min(c) OVER (PARTITION BY store, product ORDER BY week_idx)) on_hand FROM z""")
def h2_state_at_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    none = given_orders(panel).withColumn("order_qty", F.lit(0.0))
    return inventory.ledger(panel, state(panel), none).select(*KEYS, "week_idx", F.col("leftover").alias("on_hand"))


@query(_LEDGER_SQL + " SELECT week_idx, sum(sold) sold, sum(shortage) shortage, round(sum(holding_cost), 6) holding_cost, CAST(count_if(shortage > 0) AS BIGINT) stockouts FROM ledger GROUP BY ALL")
def h4_weekly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).groupBy("week_idx").agg(F.sum("sold").alias("sold"), F.sum("shortage").alias("shortage"), F.round(F.sum("holding_cost"), 6).alias("holding_cost"), F.count_if(F.col("shortage") > 0).alias("stockouts"))


@query(_LEDGER_SQL + " SELECT store, product, round(sum(sold) / sum(demand), 6) fill_rate, round(avg(CASE WHEN shortage = 0 THEN 1.0 ELSE 0.0 END), 6) service_level, round(sum(holding_cost + shortage_cost), 6) total_cost FROM ledger GROUP BY ALL")
def h6_h7_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).groupBy(*KEYS).agg(F.round(F.sum("sold") / F.sum("demand"), 6).alias("fill_rate"), F.round(F.avg((F.col("shortage") == 0).cast("double")), 6).alias("service_level"), F.round(F.sum(F.col("holding_cost") + F.col("shortage_cost")), 6).alias("total_cost"))


@query("SELECT store, product, week_idx, lead(demand, 2) OVER (PARTITION BY store, product ORDER BY week_idx) perfect FROM panel")
def h11_perfect_foresight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.lead("demand", 2).over(Window.partitionBy(*KEYS).orderBy("week_idx")).alias("perfect"))


@query(_LEDGER_SQL + " SELECT CASE WHEN grouping(week_idx) = 1 THEN -1 ELSE week_idx END AS week_idx, round(sum(sold * 3.0), 6) revenue, round(sum(sold * 1.2 - holding_cost), 6) profit, round(sum(shortage * 3.0), 6) lost FROM ledger GROUP BY ROLLUP (week_idx)")
def h13_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly revenue, profit and lost sales at a price of 3 and a margin of 1.2, and their total as week -1."""
    rows = _ledger(spark, sf_dir).rollup("week_idx").agg(F.grouping("week_idx").alias("g"), F.round(F.sum(F.col("sold") * 3.0), 6).alias("revenue"), F.round(F.sum(F.col("sold") * 1.2 - F.col("holding_cost")), 6).alias("profit"), F.round(F.sum(F.col("shortage") * 3.0), 6).alias("lost"))
    return rows.select(F.when(F.col("g") == 1, -1).otherwise(F.col("week_idx")).alias("week_idx"), "revenue", "profit", "lost")


@query(_LEDGER_SQL + " SELECT round(sum(holding_cost), 4) holding, round(sum(shortage_cost), 4) shortage, round(sum(sold) / sum(demand), 6) fill_rate, count(DISTINCT CASE WHEN shortage > 0 THEN {'store': store, 'product': product} END) stockout_series FROM ledger")
def h14_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stockout = F.count_distinct(F.when(F.col("shortage") > 0, F.struct(*KEYS)))
    return _ledger(spark, sf_dir).agg(F.round(F.sum("holding_cost"), 4).alias("holding"), F.round(F.sum("shortage_cost"), 4).alias("shortage"), F.round(F.sum("sold") / F.sum("demand"), 6).alias("fill_rate"), stockout.alias("stockout_series"))


@query(""", s AS (SELECT store, product, avg(demand) mu, stddev_samp(demand) sd FROM panel GROUP BY ALL) SELECT store, product, greatest(0.0, round_even(mu * 3 + 0.967 * sd * sqrt(3.0) - (on_hand + intransit_1 + intransit_2), 0)) order_qty FROM s JOIN state USING (store, product)""")
def g1_base_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    s = panel.groupBy(*KEYS).agg(F.avg("demand").alias("mu"), F.stddev_samp("demand").alias("sd")).join(state(panel), KEYS)
    return s.select(*KEYS, inventory.base_stock(F.col("mu"), F.col("sd"), F.col("on_hand") + F.col("intransit_1") + F.col("intransit_2")).alias("order_qty"))


@query(", s AS (SELECT store, product, CAST(round_even(avg(demand), 0) AS INTEGER) c FROM panel GROUP BY ALL) SELECT store, product, CAST(unnest(range(greatest(0, c - 10), c + 11, 5)) AS INTEGER) q FROM s")
def g2_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.bround(F.avg("demand")).cast("int").alias("c"))
    return s.select(*KEYS, F.explode(F.sequence(F.greatest(F.lit(0), F.col("c") - 10), F.col("c") + 10, F.lit(5))).alias("q"))


_STOCK_SQL = _PMF_SQL + """, lft AS (SELECT s.store, s.product, greatest(CAST(on_hand AS INTEGER) - x, 0) AS x, sum(p) p FROM state s JOIN pmf ON s.store = pmf.store AND s.product = pmf.product GROUP BY ALL),
net AS (SELECT d.store, d.product, d.x - l.x AS x, sum(d.p * l.p) p FROM pmf d JOIN lft l ON d.store = l.store AND d.product = l.product GROUP BY d.store, d.product, d.x - l.x)"""


def _stock(panel: DataFrame) -> DataFrame:
    return state(panel).select(*KEYS, F.col("on_hand").cast("int").alias("x"), F.lit(1.0).alias("p"))


@query(_STOCK_SQL + ", c AS (SELECT *, sum(p) OVER (PARTITION BY store, product ORDER BY x) cdf FROM net) SELECT store, product, greatest(min(x), 0) order_qty FROM c WHERE cdf >= 1.0 / 1.2 - 1e-9 GROUP BY ALL")
def g4_newsvendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    return inventory.newsvendor_order(_pmf(spark, sf_dir), _stock(panel), KEYS)


@query(_STOCK_SQL + " SELECT store, product, CAST(q AS INTEGER) q, round(sum(p * (0.2 * greatest(q - x, 0) + greatest(x - q, 0))), 6) AS cost FROM net JOIN (SELECT store, product, unnest(range(greatest(max(x), 0) + 1)) q FROM net GROUP BY store, product) USING (store, product) GROUP BY ALL")
def g6_g7_cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf, panel = _pmf(spark, sf_dir), demand_panel(spark, sf_dir)
    net = inventory.convolve(pmf, inventory.leftover(pmf, _stock(panel), KEYS), KEYS, F.col("xa") - F.col("xb"))
    return inventory.cost_curve(net, KEYS).withColumn("cost", F.round("cost", 6))


@query(""", d AS (SELECT store, product, avg(demand) FILTER (week_idx >= 344) d FROM panel GROUP BY ALL) SELECT store, product, greatest(0.0, round_even(d + 0.2 * sqrt(d) - greatest(greatest(on_hand + intransit_1 - d, 0) + intransit_2 - d, 0), 0)) order_qty FROM d JOIN state USING (store, product)""")
def g8_analytical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftovers projected on point forecasts for two weeks; the order fills up to the third week's forecast and a safety part."""
    panel = demand_panel(spark, sf_dir)
    d = panel.where("week_idx >= 344").groupBy(*KEYS).agg(F.avg("demand").alias("d")).join(state(panel), KEYS)
    zero = F.lit(0.0)
    one = F.greatest(F.col("on_hand") + F.col("intransit_1") - F.col("d"), zero)
    two = F.greatest(one + F.col("intransit_2") - F.col("d"), zero)
    return d.select(*KEYS, F.greatest(zero, F.bround(F.col("d") + 0.2 * F.sqrt("d") - two)).alias("order_qty"))


@query(""", s AS (SELECT store, product, avg(demand) m, stddev_samp(demand) sd, sqrt(avg((demand - mm) ** 2)) rmse, avg(abs(demand - mm)) mae FROM (SELECT *, avg(demand) OVER (PARTITION BY store, product) mm FROM panel) GROUP BY ALL)
SELECT store, product, policy, round(CASE policy WHEN 'z_sigma_L' THEN 0.967 * sd * sqrt(3) WHEN 'z_sigma_LR' THEN 0.967 * sd * sqrt(4) WHEN 'z_rmse_LR' THEN 0.967 * rmse * sqrt(4) WHEN 'k_rmse' THEN 1.5 * rmse ELSE 1.5 * mae END, 6) safety FROM s, (SELECT unnest(['z_sigma_L','z_sigma_LR','z_rmse_LR','k_rmse','k_mae']) policy)""")
def g9_safety_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("mm", F.avg("demand").over(Window.partitionBy(*KEYS)))
    e = F.col("demand") - F.col("mm")
    s = rows.groupBy(*KEYS).agg(F.stddev_samp("demand").alias("sd"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    rules = {"z_sigma_L": 0.967 * F.col("sd") * 3**0.5, "z_sigma_LR": 0.967 * F.col("sd") * 2.0, "z_rmse_LR": 0.967 * F.col("rmse") * 2.0, "k_rmse": 1.5 * F.col("rmse"), "k_mae": 1.5 * F.col("mae")}
    return s.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), F.round(c, 6).alias("safety")) for n, c in rules.items()))).alias("r")).select(*KEYS, "r.policy", "r.safety")


@query("SELECT store, product, least(0.99, greatest(0.5, CASE WHEN product % 5 = 0 THEN 0.9 ELSE 0.833 END + CASE WHEN store = 0 THEN 0.1 ELSE 0 END))::DOUBLE service_level FROM state")
def g10_service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A general level, overridden for some series and shifted by a bias, held between .5 and .99."""
    every = state(demand_panel(spark, sf_dir)).select(*KEYS)
    overrides = every.where("product % 5 = 0").withColumn("own", F.lit(0.9))
    level = F.coalesce("own", F.lit(0.833)) + F.when(F.col("store") == 0, 0.1).otherwise(0.0)
    return every.join(overrides, KEYS, "left").select(*KEYS, F.least(F.lit(0.99), F.greatest(F.lit(0.5), level)).alias("service_level"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    both = forecasts.seasonal_naive(train).withColumn("model", F.lit("seasonal")).unionByName(forecasts.naive_mean(train).withColumn("model", F.lit("mean")))
    return both.join(test, [*FOLD, "step"])


_SCORED_SQL = _NAIVE_SQL + _MEAN_SQL + ", sc AS (SELECT model, f.*, y FROM (SELECT 'seasonal' AS model, * FROM fq UNION ALL SELECT 'mean', * FROM fm) f JOIN test USING (store, product, fold_idx, step))"
_PER_SQL = _SCORED_SQL + """, ls AS (SELECT *, greatest(tau * (y - value), (tau - 1) * (y - value)) loss FROM sc), tz AS (SELECT *, lead(tau) OVER w tau2, lead(loss) OVER w loss2 FROM ls WINDOW w AS (PARTITION BY model, store, product, fold_idx, step ORDER BY tau)),
per AS (SELECT model, store, product, fold_idx, step, avg(loss) pinball, sum((loss + loss2) * (tau2 - tau)) crps, any_value(y) y, any_value(y) - max(value) FILTER (tau = 0.5) error, max(value) FILTER (tau = 0.9) - max(value) FILTER (tau = 0.1) width_80,
 CAST(any_value(y) BETWEEN max(value) FILTER (tau = 0.1) AND max(value) FILTER (tau = 0.9) AS INTEGER) covered_80, max(value) FILTER (tau = 0.95) - max(value) FILTER (tau = 0.05) width_90, CAST(any_value(y) BETWEEN max(value) FILTER (tau = 0.05) AND max(value) FILTER (tau = 0.95) AS INTEGER) covered_90 FROM tz GROUP BY model, store, product, fold_idx, step)"""
MODEL = ["model", *FOLD, "step"]


@query(_PER_SQL + " SELECT model, store, product, fold_idx, step, round(pinball, 6) pinball, round(crps, 6) crps, round(error, 6) error, round(width_80, 6) width_80, covered_80, round(width_90, 6) width_90, covered_90 FROM per")
def i1_i2_i3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.per_forecast(_scored(spark, sf_dir), MODEL).drop("y")
    return rows.select(*MODEL, *(F.round(c, 6).alias(c) if not c.startswith("covered") else c for c in rows.columns if c not in MODEL))


@query(_PER_SQL + " SELECT model, round(avg(abs(error)), 6) mae, round(sqrt(avg(error * error)), 6) rmse, round(avg(abs(error) / (y + 1)), 6) mape, round(-avg(error), 6) bias, round(avg(pinball), 6) pinball, round(avg(crps), 6) crps, round(avg(covered_80), 6) coverage_80, round(avg(error) ** 2, 6) bias_sq, round(var_pop(error), 6) variance FROM per GROUP BY ALL")
def i4_i17_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: point errors, mean losses, coverage, and the error's split into squared bias and variance."""
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL)
    e = F.col("error")
    c = {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.abs(e) / (F.col("y") + 1)), "bias": -F.avg(e), "pinball": F.avg("pinball"), "crps": F.avg("crps"), "coverage_80": F.avg("covered_80"), "bias_sq": F.avg(e) ** 2, "variance": F.var_pop("error")}
    return per.groupBy("model").agg(*(F.round(v, 6).alias(n) for n, v in c.items()))


@query(_PER_SQL + ", nv AS (SELECT store, product, fold_idx, avg(abs(demand - l)) scale FROM (SELECT *, lag(demand, 52) OVER (PARTITION BY store, product, fold_idx ORDER BY week_idx) l FROM train) GROUP BY ALL) SELECT model, store, product, fold_idx, round(avg(abs(error)) / nullif(any_value(scale), 0), 6) mase FROM per LEFT JOIN nv USING (store, product, fold_idx) GROUP BY ALL")
def i5_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error per fold over that of the value a year before in the fold's training weeks alone; null without such weeks or where that is 0."""
    train = _train_test(spark, sf_dir)[0]
    scale = train.groupBy(*FOLD).agg(F.avg(F.abs(F.col("demand") - F.col("year_ago"))).alias("scale"))
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL).groupBy("model", *FOLD).agg(F.avg(F.abs("error")).alias("mae"))
    return per.join(scale, FOLD, "left").select("model", *FOLD, F.round(F.try_divide(F.col("mae"), F.col("scale")), 6).alias("mase"))


@query(_SCORED_SQL + ", wl AS (SELECT *, greatest(tau * (y - value), (tau - 1) * (y - value)) loss, exp(-0.5 * ((tau - 0.8333) / 0.05) ** 2) w FROM sc WHERE tau BETWEEN 0.73 AND 0.93) SELECT model, round(sum(w * loss) / sum(w), 6) weighted_pinball FROM wl GROUP BY ALL")
def i8_weighted_pinball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinball weighted by a normal curve around the critical fractile, at the levels from 0.73 to 0.93."""
    w = F.exp(-0.5 * ((F.col("tau") - 0.8333) / 0.05) ** 2)
    loss = scoring.pinball(F.col("tau"), F.col("value"), F.col("y"))
    return _scored(spark, sf_dir).where("tau between 0.73 and 0.93").groupBy("model").agg(F.round(F.sum(w * loss) / F.sum(w), 6).alias("weighted_pinball"))


@query(_PMF_SQL + ", y AS (SELECT store, product, demand y FROM panel WHERE week_idx = 300) SELECT pmf.store, pmf.product, round(sum(p * abs(x - y)), 6) w1 FROM pmf JOIN y USING (store, product) GROUP BY ALL")
def i9_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = demand_panel(spark, sf_dir).where("week_idx = 300").select(*KEYS, F.col("demand").alias("y"))
    return _pmf(spark, sf_dir).join(y, KEYS).groupBy(*KEYS).agg(F.round(F.sum(F.col("p") * F.abs(F.col("x") - F.col("y"))), 6).alias("w1"))


@query(_SCORED_SQL + """, nx AS (SELECT *, lead(tau) OVER w t2, lead(value) OVER w v2 FROM sc WINDOW w AS (PARTITION BY model, store, product, fold_idx, step ORDER BY tau)),
pt AS (SELECT model, store, product, fold_idx, step, coalesce(max(CASE WHEN y >= value AND y < v2 THEN tau + (t2 - tau) * (y - value) / (v2 - value) END), CASE WHEN any_value(y) < arg_min(value, tau) THEN 0.01 WHEN any_value(y) >= arg_max(value, tau) THEN 0.99 END) pit FROM nx GROUP BY ALL),
g AS (SELECT model, pit, row_number() OVER (PARTITION BY model ORDER BY pit) i, count(*) OVER (PARTITION BY model) n FROM pt) SELECT model, round(max(greatest(i / n - pit, pit - (i - 1) / n)), 6) ks, count(*) n FROM g GROUP BY ALL""")
def i12_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.distance_to_uniform(scoring.pit(_scored(spark, sf_dir), MODEL), ["model"]).withColumn("ks", F.round("ks", 6))


@query(_PMF_SQL + " SELECT pmf.store, pmf.product, round(coalesce(sum(p) FILTER (x > on_hand), 0), 6) p_stockout, CAST(coalesce(sum(p) FILTER (x > on_hand), 0) > 0.5 AS INTEGER) flagged FROM pmf JOIN state USING (store, product) GROUP BY ALL")
def i13_stockout_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of weeks whose rounded demand is above the stock on hand, from whole counts: half of the weeks is half, whatever order they are met in."""
    panel = demand_panel(spark, sf_dir)
    rows = inventory.share_above(panel.where("week_idx >= 253").join(state(panel), KEYS), KEYS, F.col("on_hand"))
    return rows.select(*KEYS, F.round(F.col("above") / F.col("n"), 6).alias("p_stockout"), (2 * F.col("above") > F.col("n")).cast("int").alias("flagged"))


@query(_PER_SQL + """, cf AS (SELECT model, step, CAST(count_if(error > 0 AND y > 25) AS BIGINT) tp, CAST(count_if(error > 0 AND y <= 25) AS BIGINT) fp, CAST(count_if(error <= 0 AND y > 25) AS BIGINT) fn FROM per GROUP BY GROUPING SETS ((model, step), (model)))
SELECT model, coalesce(step, -1) AS step, tp, fp, fn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) f1 FROM cf""")
def i14_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under-forecasts against high demand: counts and F1 by step and overall (step -1)."""
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL)
    under, high = F.col("error") > 0, F.col("y") > 25
    counts = [F.count_if(under & high).alias("tp"), F.count_if(under & ~high).alias("fp"), F.count_if(~under & high).alias("fn")]
    sets = per.groupBy("model", "step").agg(*counts).unionByName(per.groupBy("model").agg(*counts).withColumn("step", F.lit(-1)))
    return sets.withColumn("f1", F.round(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


@query(_PER_SQL + ", m AS (SELECT model, store, product, avg(pinball) pinball FROM per GROUP BY ALL) SELECT store, product, arg_min(model, (round(pinball, 9), model)) AS model, round(min(pinball), 6) pinball, count(*) n_models FROM m GROUP BY ALL")
def j3_best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL).groupBy("model", *KEYS).agg(F.avg("pinball").alias("pinball"))
    return per.groupBy(*KEYS).agg(F.min_by("model", F.struct(F.round("pinball", 9), "model")).alias("model"), F.round(F.min("pinball"), 6).alias("pinball"), F.count("*").alias("n_models"))


@query(_PER_SQL + ", m AS (SELECT model, store, product, avg(pinball) pinball, avg(crps) crps FROM per GROUP BY ALL) SELECT model, round(sum(pinball), 5) total, round(avg(pinball), 6) mean, round(stddev_samp(pinball), 6) sd, count(*) n, round(quantile_cont(pinball, 0.05), 6) p05, round(quantile_cont(pinball, 0.5), 6) p50, round(quantile_cont(pinball, 0.95), 6) p95 FROM m GROUP BY ALL")
def j1_j4_model_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds to series to models."""
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL).groupBy("model", *KEYS).agg(F.avg("pinball").alias("v"))
    q = lambda p: F.round(F.percentile("v", F.lit(p)), 6)
    return per.groupBy("model").agg(F.round(F.sum("v"), 5).alias("total"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.count("*").alias("n"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


@query(_SCORED_SQL + """, w AS (SELECT store, product, fold_idx, step, tau, sum(value * CASE WHEN model = 'mean' THEN 0.6 ELSE 0.4 END) v FROM sc GROUP BY ALL)
SELECT store, product, fold_idx, step, tau, round(max(v) OVER (PARTITION BY store, product, fold_idx, step ORDER BY tau), 6) AS value FROM w""")
def j10_pooled_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of the models' quantiles, made monotone by a running maximum."""
    w = F.when(F.col("model") == "mean", 0.6).otherwise(0.4)
    rows = _scored(spark, sf_dir).groupBy(*FOLD, "step", "tau").agg(F.sum(F.col("value") * w).alias("v"))
    return rows.select(*FOLD, "step", "tau", F.round(F.max("v").over(Window.partitionBy(*FOLD, "step").orderBy("tau")), 6).alias("value"))


@query(_PER_SQL + """, f AS (SELECT model, store, product, fold_idx, avg(pinball) c FROM per GROUP BY ALL), d AS (SELECT *, dense_rank() OVER (ORDER BY fold_idx DESC) r FROM f), s AS (SELECT model, store, product, avg(c) c, count(DISTINCT fold_idx) k FROM d WHERE r <= 8 GROUP BY ALL HAVING count(DISTINCT fold_idx) = 8)
SELECT store, product, model, CAST(row_number() OVER (PARTITION BY store, product ORDER BY round(c, 9), model) AS INTEGER) AS rank, round(c, 6) AS cost FROM s""")
def j2_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models ranked per series on the last eight folds, those that cover all of them."""
    per = scoring.per_forecast(_scored(spark, sf_dir), MODEL).groupBy("model", *FOLD).agg(F.avg("pinball").alias("c"))
    last = per.select("fold_idx").distinct().orderBy(F.desc("fold_idx")).limit(8)
    s = per.join(F.broadcast(last), "fold_idx").groupBy("model", *KEYS).agg(F.avg("c").alias("c"), F.count_distinct("fold_idx").alias("k")).where("k = 8")
    return s.select(*KEYS, "model", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.round("c", 9), "model")).alias("rank"), F.round("c", 6).alias("cost"))
