"""Registered queries: costs of forecasts, calibration, correction, and choices between models, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import evaluation, inventory
from .plans.bindings import KEYS, demand_panel, state
from .queries_models import _PER_SQL, _SCORED_SQL, FOLD, MODEL, _scored
from .queries_selection import _per
from .queries_statistics import _NEAR_SQL, d9_imputed_panel
from .registry import query


def _pmf_sql(source: str) -> str:
    """pf: distributions of the forecasts (store, product, fold_idx, step, tau, value) that ``source`` selects."""
    k = "store, product, fold_idx, step"
    return f""", src AS ({source}), pts AS (SELECT {k}, tau, max(greatest(value, 0)) OVER (PARTITION BY {k} ORDER BY tau) v FROM src),
tp AS (SELECT {k}, max(v) AS mx FROM pts GROUP BY ALL), al AS (SELECT * FROM pts UNION ALL SELECT {k}, 0.0, 0.0 FROM tp UNION ALL SELECT {k}, 1.0, mx FROM tp),
sg AS (SELECT *, lead(tau) OVER w t2, lead(v) OVER w v2 FROM al WINDOW w AS (PARTITION BY {k} ORDER BY tau, v)), su AS (SELECT {k}, unnest(range(0, CAST(ceil(mx) AS BIGINT) + 1)) AS x FROM tp),
cd AS (SELECT {k}, x, coalesce(max(CASE WHEN v2 > v AND x >= v AND x < v2 THEN tau + (t2 - tau) * (x - v) / (v2 - v) END), 1.0) cdf FROM su JOIN sg USING ({k}) GROUP BY ALL),
df AS (SELECT *, greatest(cdf - coalesce(lag(cdf) OVER (PARTITION BY {k} ORDER BY x), 0), 0) p0 FROM cd), pf AS (SELECT {k}, x, p0 / sum(p0) OVER (PARTITION BY {k}) p FROM df)"""


_WEEK2_SQL = """, lf AS (SELECT store, product, fold_idx, greatest(CAST(on_hand AS INTEGER) + CAST(intransit_1 AS INTEGER) - x, 0) + CAST(intransit_2 AS INTEGER) s, sum(p) p FROM pf JOIN state USING (store, product) WHERE step = 1 GROUP BY ALL),
nt AS (SELECT d.store, d.product, d.fold_idx, d.x - l.s AS x, sum(d.p * l.p) p FROM pf d JOIN lf l ON d.store = l.store AND d.product = l.product AND d.fold_idx = l.fold_idx WHERE d.step = 2 GROUP BY d.store, d.product, d.fold_idx, d.x - l.s),
od AS (SELECT store, product, fold_idx, greatest(min(x), 0) order_qty FROM (SELECT *, sum(p) OVER (PARTITION BY store, product, fold_idx ORDER BY x) cdf FROM nt) WHERE cdf >= 1.0 / 1.2 - 1e-9 GROUP BY ALL),
ec AS (SELECT store, product, fold_idx, order_qty, sum(p * (0.2 * greatest(order_qty - x, 0) + greatest(x - order_qty, 0))) expected_cost FROM nt JOIN od USING (store, product, fold_idx) GROUP BY ALL),
ys AS (SELECT store, product, fold_idx, round_even(max(y) FILTER (step = 1), 0) y1, round_even(max(y) FILTER (step = 2), 0) y2 FROM test GROUP BY ALL)"""
_MEAN_COST_SQL = _SCORED_SQL + _pmf_sql("SELECT store, product, fold_idx, step, tau, value FROM sc WHERE model = 'mean'") + _WEEK2_SQL
_COST_SQL = _MEAN_COST_SQL + """, ct AS (SELECT *, 0.2 * greatest(ps - y2, 0) holding_cost, greatest(y2 - ps, 0) shortage_cost FROM (SELECT *, greatest(on_hand + intransit_1 - y1, 0) + intransit_2 + order_qty ps FROM ec JOIN ys USING (store, product, fold_idx) JOIN state USING (store, product)))"""


def _orders(rows: DataFrame, panel: DataFrame) -> DataFrame:
    return evaluation.second_week_orders(rows, state(panel), FOLD, KEYS)


def _outcomes(rows: DataFrame) -> DataFrame:
    y = lambda s: F.max(F.when(F.col("step") == s, F.col("y"))).alias(f"y{s}")
    return rows.groupBy(*FOLD).agg(y(1), y(2))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, panel = _scored(spark, sf_dir).where("model = 'mean'"), demand_panel(spark, sf_dir)
    both = _orders(rows, panel).join(_outcomes(rows), FOLD).join(state(panel), KEYS)
    return evaluation.realised(both, F.col("order_qty")).withColumn("realised_cost", F.col("holding_cost") + F.col("shortage_cost"))


@query(_COST_SQL + " SELECT store, product, fold_idx, CAST(order_qty AS INTEGER) order_qty, round(expected_cost, 5) expected_cost, round(holding_cost, 5)::DOUBLE holding_cost, round(shortage_cost, 5)::DOUBLE shortage_cost, round(holding_cost + shortage_cost, 5)::DOUBLE realised_cost FROM ct")
def h8_expected_and_realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per series and fold, the second week's best order by forecast, its expected cost and what it costs."""
    return _costs(spark, sf_dir).select(*FOLD, "order_qty", *(F.round(c, 5).alias(c) for c in ("expected_cost", "holding_cost", "shortage_cost", "realised_cost")))


@query(_MEAN_COST_SQL + """, fr AS (SELECT * FROM (SELECT DISTINCT store, product FROM ys) CROSS JOIN (SELECT DISTINCT fold_idx FROM ys ORDER BY fold_idx DESC LIMIT 8)), pr AS (SELECT * FROM od WHERE (store + product + fold_idx) % 5 <> 0),
al2 AS (SELECT fr.*, pr.order_qty IS NULL AS missing, greatest(on_hand + intransit_1 - y1, 0) + intransit_2 + coalesce(pr.order_qty, 0) ps, y2 FROM fr JOIN ys USING (store, product, fold_idx) JOIN state USING (store, product) LEFT JOIN pr USING (store, product, fold_idx))
SELECT store, product, CAST(count_if(missing) AS BIGINT) n_missing, count(*) n_folds, round(sum(0.2 * greatest(ps - y2, 0) + greatest(y2 - ps, 0)), 4)::DOUBLE total_cost FROM al2 GROUP BY ALL""")
def h9_eight_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each series over the last eight folds. A fold without a prediction (here one in five) orders nothing."""
    rows, panel = _scored(spark, sf_dir).where("model = 'mean'"), demand_panel(spark, sf_dir)
    outcomes = _outcomes(rows)
    folds = outcomes.select("fold_idx").distinct().orderBy(F.desc("fold_idx")).limit(8)
    frame = outcomes.select(*KEYS).distinct().crossJoin(F.broadcast(folds))  # eight rows
    predicted = _orders(rows, panel).where((F.col("store") + F.col("product") + F.col("fold_idx")) % 5 != 0).select(*FOLD, "order_qty")
    every = frame.join(outcomes, FOLD).join(state(panel), KEYS).join(predicted, FOLD, "left")
    cost = evaluation.realised(every, F.coalesce("order_qty", F.lit(0)))
    return cost.groupBy(*KEYS).agg(F.count_if(F.col("order_qty").isNull()).alias("n_missing"), F.count("*").alias("n_folds"), F.round(F.sum(F.col("holding_cost") + F.col("shortage_cost")), 4).alias("total_cost"))


@query(_PER_SQL + ", pk AS (SELECT store, product, CASE WHEN product % 7 = 0 THEN 'mean' ELSE arg_min(model, (round(c, 9), model)) END AS model FROM (SELECT store, product, model, avg(pinball) c FROM per GROUP BY ALL) GROUP BY store, product)" + _pmf_sql("SELECT store, product, fold_idx, step, tau, value FROM sc JOIN pk USING (store, product, model) WHERE fold_idx = (SELECT max(fold_idx) FROM sc) AND (store + product) % 9 <> 4") + _WEEK2_SQL + " SELECT store, product, CAST(coalesce(order_qty, 0) AS INTEGER) order_qty FROM state LEFT JOIN od USING (store, product)")
def g13_todays_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from each series' chosen model (some overridden) at the latest fold; series without a forecast (here one in nine) order nothing."""
    panel, rows = demand_panel(spark, sf_dir), _scored(spark, sf_dir)
    picks = evaluation.cheapest(_per(spark, sf_dir), KEYS, "pinball").select(*KEYS, F.when(F.col("product") % 7 == 0, "mean").otherwise(F.col("pick")).alias("model"))
    last = rows.agg(F.max("fold_idx").alias("fold_idx"))
    chosen = rows.join(F.broadcast(last), "fold_idx").where((F.col("store") + F.col("product")) % 9 != 4).join(picks, [*KEYS, "model"])  # one row
    orders = _orders(chosen, panel).select(*KEYS, "order_qty")
    return state(panel).select(*KEYS).join(orders, KEYS, "left").select(*KEYS, F.coalesce("order_qty", F.lit(0)).alias("order_qty"))


@query(_SCORED_SQL + ", st AS (SELECT model, store, product, fold_idx, step, max(value) - min(value) < 1e-6 AS flat FROM sc WHERE step IN (1, 2) GROUP BY model, store, product, fold_idx, step) SELECT model, store, product, fold_idx, bool_or(flat) degenerate FROM st GROUP BY ALL")
def f19_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.degenerate(_scored(spark, sf_dir), ["model", *FOLD])


@query(_SCORED_SQL + """, rc AS (SELECT model, tau, round(y - value, 6) res, count(*) c FROM sc WHERE fold_idx < 8 GROUP BY ALL), rk AS (SELECT *, sum(c) OVER (PARTITION BY model, tau ORDER BY res) cum, sum(c) OVER (PARTITION BY model, tau) n FROM rc),
aj AS (SELECT model, tau, min(res) adjustment FROM rk WHERE cum >= greatest(1, least(n, ceil(round((n + 1) * tau, 9)))) GROUP BY ALL)
SELECT model, store, product, fold_idx, step, tau, round(max(greatest(0.0, value + coalesce(adjustment, 0.0))) OVER (PARTITION BY model, store, product, fold_idx, step ORDER BY tau), 5) AS value FROM sc LEFT JOIN aj USING (model, tau) WHERE fold_idx >= 8""")
def f20_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the last four folds moved by the order statistics of the earlier folds' residuals."""
    rows = _scored(spark, sf_dir)
    moves = evaluation.conformal_adjustments(rows.where("fold_idx < 8"), ["model"])
    out = evaluation.calibrated(rows.where("fold_idx >= 8").drop("y"), moves, ["model"], MODEL)
    return out.select(*MODEL, "tau", F.round("value", 5).alias("value"))


@query(_SCORED_SQL + """, a AS (SELECT *, CASE WHEN model = 'seasonal' THEN greatest(value * 1.2, 1.0) END a FROM sc), m AS (SELECT *, quantile_cont(a, 0.5) OVER (PARTITION BY model, store, product, fold_idx, step) md FROM a)
SELECT model, store, product, fold_idx, step, tau, round(CASE WHEN a IS NULL THEN value ELSE greatest(0.0, md + (a - md) * 1.1) END, 5) AS value FROM m""")
def f21_bias_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections for one of the models: a fifth more, 1 at least, a tenth wider."""
    factors = spark.createDataFrame([("seasonal", 1.2, 1.0, 1.1)], "model string, multiplier double, floor double, spread double")
    rows = evaluation.bias_corrected(_scored(spark, sf_dir), F.broadcast(factors), "model", MODEL)  # a row for each model
    return rows.select(*MODEL, "tau", F.round("value", 5).alias("value"))


@query(_PER_SQL + " SELECT model, count(*) n, round(avg(pinball), 6) pinball, round(avg(crps), 6) crps, round(avg(abs(error)), 6) mae, round(avg(covered_80), 6) coverage_80 FROM per WHERE fold_idx >= 4 GROUP BY ALL")
def j6_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric means of each model over the last eight folds."""
    c = {"pinball": F.avg("pinball"), "crps": F.avg("crps"), "mae": F.avg(F.abs("error")), "coverage_80": F.avg("covered_80")}
    return _per(spark, sf_dir).where("fold_idx >= 4").groupBy("model").agg(F.count("*").alias("n"), *(F.round(v, 6).alias(n) for n, v in c.items()))


@query(_SCORED_SQL + _pmf_sql("SELECT store, product, CASE model WHEN 'mean' THEN 0 ELSE 1 END AS fold_idx, step, tau, value FROM sc WHERE step = 2 AND fold_idx = (SELECT max(fold_idx) FROM sc)") + """, cv AS (SELECT store, product, fold_idx, q, sum(p * (0.2 * greatest(q - x, 0) + greatest(x - q, 0))) AS c FROM pf JOIN (SELECT store, product, fold_idx, unnest(range(max(x) + 1)) q FROM pf GROUP BY store, product, fold_idx) USING (store, product, fold_idx) GROUP BY ALL),
pl AS (SELECT store, product, q, sum(c * CASE fold_idx WHEN 0 THEN 0.6 ELSE 0.4 END) c, count(*) n FROM cv GROUP BY ALL) SELECT store, product, CAST(arg_min(q, (round(c, 9), q)) AS INTEGER) order_qty, round(min(c), 5) AS cost FROM pl WHERE n = 2 GROUP BY ALL""")
def j11_pooled_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that minimises the weighted mean of two models' cost curves for the second week of the latest fold."""
    rows = _scored(spark, sf_dir)
    last = rows.agg(F.max("fold_idx").alias("fold_idx"))
    pmf = inventory.quantiles_to_pmf(rows.where("step = 2").join(F.broadcast(last), "fold_idx"), ["model", *KEYS])  # one row
    weights = spark.createDataFrame([("mean", 0.6), ("seasonal", 0.4)], "model string, weight double")
    best = evaluation.pooled_order(inventory.cost_curve(pmf, ["model", *KEYS]), F.broadcast(weights), KEYS)  # a row for each model
    return best.select(*KEYS, "order_qty", F.round("cost", 5).alias("cost"))


@query(_PER_SQL + """, m AS (SELECT 'static' AS kind, -1 AS fold_idx, store, product, model, avg(crps) c FROM per GROUP BY ALL UNION ALL SELECT 'weekly', fold_idx, store, product, model, avg(crps) FROM per GROUP BY fold_idx, store, product, model)
SELECT kind, fold_idx, store, product, arg_min(model, (round(c, 9), model)) AS pick, round(min(c), 6) AS crps FROM m GROUP BY ALL""")
def j13_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of the least CRPS for each series, and for each series and fold."""
    per = _per(spark, sf_dir)
    static = evaluation.cheapest(per, KEYS, "crps").select(F.lit("static").alias("kind"), F.lit(-1).alias("fold_idx"), *KEYS, "pick", "c")
    weekly = evaluation.cheapest(per, FOLD, "crps").select(F.lit("weekly").alias("kind"), "fold_idx", *KEYS, "pick", "c")
    return static.unionByName(weekly).withColumn("crps", F.round("c", 6)).drop("c")


@query(_COST_SQL + """, pb AS (SELECT store, product, fold_idx, expected_cost, holding_cost + shortage_cost AS realised_cost, (holding_cost + shortage_cost) / greatest(expected_cost, 0.01) cost_ratio, holding_cost, shortage_cost FROM ct), sv AS (SELECT *, (realised_cost - expected_cost) * ln(1 + realised_cost) severity FROM pb WHERE realised_cost > expected_cost)
SELECT store, product, fold_idx, round(cost_ratio, 4) cost_ratio, round(severity, 4) severity, coalesce(nullif(concat_ws(',', CASE WHEN expected_cost < 0.01 AND realised_cost > 1 THEN 'ZERO_PREDICTION' END, CASE WHEN cost_ratio > 5 THEN 'MASSIVE_UNDERESTIMATE' END, CASE WHEN realised_cost > 20 THEN 'HIGH_COST' END, CASE WHEN shortage_cost > 0 AND holding_cost = 0 THEN 'PURE_SHORTAGE' END), ''), 'MODERATE_ERROR') problem
FROM sv ORDER BY round(severity, 6) DESC, store, product, fold_idx LIMIT 20""")
def j21_problem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty forecasts that cost most beyond what was expected."""
    costs = _costs(spark, sf_dir).select(*FOLD, "expected_cost", "realised_cost", "holding_cost", "shortage_cost")
    return evaluation.problems(costs, 20).select(*FOLD, F.round("cost_ratio", 4).alias("cost_ratio"), F.round("severity", 4).alias("severity"), "problem")


@query(_SCORED_SQL + ", e AS (SELECT store, product, model, avg(abs(y - value)) c FROM sc WHERE step = 3 AND tau = 0.5 GROUP BY ALL) SELECT store, product, arg_min(model, (round(c, 9), model)) AS pick, round(min(c), 6) AS mae_3 FROM e GROUP BY ALL")
def j31_third_week_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model whose median is nearest three weeks ahead."""
    rows = _scored(spark, sf_dir).where("step = 3 and tau = 0.5").withColumn("e", F.abs(F.col("y") - F.col("value")))
    return evaluation.cheapest(rows, KEYS, "e").select(*KEYS, "pick", F.round("c", 6).alias("mae_3"))


@query(""", w AS (SELECT store, product, weekofyear(week) iso, demand - avg(demand) OVER c d, count(*) OVER c n FROM panel WINDOW c AS (PARTITION BY store, product ORDER BY week_idx ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)),
r AS (SELECT *, d - avg(d) OVER (PARTITION BY store, product, iso) r FROM w WHERE n = 53) SELECT store, product, round(greatest(0.0, 1 - var_pop(r) / var_pop(d)), 6) strength FROM r GROUP BY ALL""")
def k9_seasonal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.seasonal_strength(demand_panel(spark, sf_dir), KEYS).withColumn("strength", F.round("strength", 6))


@query(""", s AS (SELECT CAST(week_idx AS BIGINT) scenario_id, store, sum(demand) demand FROM panel GROUP BY ALL), n AS (SELECT max(scenario_id) + 1 n FROM s)
SELECT CAST(d AS BIGINT) draw_id, scenario_id, store, demand FROM (SELECT d, (d * 2654435761 + 12345) % n AS scenario_id FROM n, (SELECT unnest(range(1000)) d)) JOIN s USING (scenario_id)""")
def e3_sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand draws, with replacement, of whole rows of the scenario table: a week's demand of all stores stays together."""
    s = demand_panel(spark, sf_dir).groupBy(F.col("week_idx").cast("long").alias("scenario_id"), "store").agg(F.sum("demand").alias("demand"))
    n = s.agg((F.max("scenario_id") + 1).alias("n"))
    draws = spark.range(1000).withColumnRenamed("id", "draw_id").crossJoin(F.broadcast(n))  # one row
    return draws.select("draw_id", F.pmod(F.col("draw_id") * 2654435761 + 12345, F.col("n")).alias("scenario_id")).join(s, "scenario_id").select("draw_id", "scenario_id", "store", "demand")


@query("""SELECT store, product, week_idx, CAST(dense_rank() OVER (ORDER BY year(week)) AS INTEGER) year_code, CAST(dense_rank() OVER (ORDER BY weekofyear(week)) AS INTEGER) week_code, demand FROM panel""")
def e12_master_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with dense codes of years and ISO weeks, ranked among their few distinct values."""
    rows = demand_panel(spark, sf_dir).withColumn("y", F.year("week")).withColumn("w", F.weekofyear("week"))
    codes = lambda c, name: rows.select(c).distinct().select(c, F.row_number().over(Window.orderBy(c)).alias(name))
    both = rows.join(F.broadcast(codes("y", "year_code")), "y").join(F.broadcast(codes("w", "week_code")), "w")  # years; 53 weeks
    return both.select(*KEYS, "week_idx", "year_code", "week_code", "demand")


@query(_NEAR_SQL + """, im AS (SELECT store, product, week_idx, greatest(any_value(demand), quantile_cont(cd, 0.5)) filled FROM kn WHERE rn <= 10 GROUP BY ALL), f AS (SELECT p.demand o, filled i FROM panel p LEFT JOIN im USING (store, product, week_idx)),
s AS (SELECT count(i)::DOUBLE n_imputed, 100.0 * count(i) / count(*) pct_imputed, avg(o) FILTER (i IS NOT NULL) mean_original_sales, avg(i) mean_imputed_sales, avg(i) - avg(o) FILTER (i IS NOT NULL) mean_lift, quantile_cont(o, 0.5) FILTER (i IS NOT NULL) median_original_sales, quantile_cont(i, 0.5) median_imputed_sales,
 quantile_cont(i, 0.5) - quantile_cont(o, 0.5) FILTER (i IS NOT NULL) median_lift, sum(o) FILTER (i IS NOT NULL) total_original_volume, sum(i) total_imputed_volume, sum(i) - sum(o) FILTER (i IS NOT NULL) volume_lift FROM f)
SELECT metric, round(value, 5) AS value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)""")
def d10_imputation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven numbers on what imputation changed."""
    both = d9_imputed_panel(spark, sf_dir).withColumnRenamed("demand", "i").join(demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.col("demand").alias("o")), [*KEYS, "week_idx"])
    some = F.col("imputed")
    o, i = F.when(some, F.col("o")), F.when(some, F.col("i"))
    half = F.lit(0.5)
    c = {"n_imputed": F.count_if(some).cast("double"), "pct_imputed": 100.0 * F.count_if(some) / F.count("*"), "mean_original_sales": F.avg(o), "mean_imputed_sales": F.avg(i), "mean_lift": F.avg(i) - F.avg(o), "median_original_sales": F.percentile(o, half), "median_imputed_sales": F.percentile(i, half)}
    c |= {"median_lift": F.percentile(i, half) - F.percentile(o, half), "total_original_volume": F.sum(o), "total_imputed_volume": F.sum(i), "volume_lift": F.sum(i) - F.sum(o)}
    return both.agg(*(v.alias(n) for n, v in c.items())).unpivot([], list(c), "metric", "value").withColumn("value", F.round("value", 5))
