"""Registered queries: composite features and learned models; with oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .operators import learned as L
from .operators import splits
from .plans.bindings import KEYS, demand_panel, read
from .queries_models import _FOLDS_SQL, FOLD, _scored, _train_test
from .queries_statistics import _BOARD_SQL, _board
from .queries_tables import scratch
from .registry import query

_BY = "PARTITION BY store, product ORDER BY week_idx"


def _rows(n: int) -> str:
    return f"({_BY} ROWS {n - 1} PRECEDING)"


_COMPOSITE_SQL = f""", e AS (SELECT *, CASE WHEN in_stock THEN demand END y_eff FROM panel),
s AS (SELECT *, greatest(1.0, 53 * coalesce(CASE WHEN count(y_eff) OVER y1 >= 45 THEN avg(y_eff) OVER y1 END, avg(y_eff) OVER y2, 0.0)) scale_factor FROM e WINDOW y1 AS ({_BY} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), y2 AS ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, y_eff / scale_factor * 1000 v, weekofyear(week) woy FROM s),
f AS (SELECT *, {', '.join(f'lag(v, {k}) OVER w lag_{k}' for k in (0, 1, 2, 3, 51, 52, 53))}, {', '.join(f'avg(v) OVER r{k} rmean_{k}, quantile_cont(v, 0.5) OVER r{k} rmedian_{k}' for k in (3, 5, 13))},
  {', '.join(f'sum(v * power({n + 1}.0 / {n - 1}.0, week_idx)) OVER ru / sum(CASE WHEN v IS NOT NULL THEN power({n + 1}.0 / {n - 1}.0, week_idx) END) OVER ru ewm_{n}' for n in (5, 10))},
  stddev_samp(v) OVER r13 rstd_13, CASE WHEN count(v) OVER r13 > 1 THEN quantile_cont(v, 0.75) OVER r13 - quantile_cont(v, 0.25) OVER r13 END riqr_13, v - lag(v, 1) OVER w delta_1, v - lag(v, 5) OVER w delta_5,
  CASE WHEN count(v) OVER r4 = count(*) OVER r4 THEN CASE count(*) OVER r4 WHEN 4 THEN (1.5 * v + 0.5 * lag(v, 1) OVER w - 0.5 * lag(v, 2) OVER w - 1.5 * lag(v, 3) OVER w) / 5 WHEN 3 THEN (v - lag(v, 2) OVER w) / 2 WHEN 2 THEN v - lag(v, 1) OVER w END END slope_4w,
  woy::DOUBLE week_of_year, {', '.join(f'{g}(2 * pi() * {k} * woy / 52) fourier_{g}_{k}' for k in (1, 2, 3) for g in ('sin', 'cos'))}, CASE WHEN row_number() OVER w > 55 THEN avg(v) OVER ({_BY} ROWS BETWEEN 55 PRECEDING AND 49 PRECEDING) END last_year_window_avg,
  avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) OVER {_rows(12)} rolling_nonzero_rate_12, lag(v, 52) OVER w ago, list(v) OVER r13 vals, count(v) OVER r13 = count(*) OVER r13 AND count(*) OVER r13 > 1 whole, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) age, {', '.join(f'lead(v, {h}) OVER w y_h{h}' for h in (1, 2, 3))}
  FROM v WINDOW w AS ({_BY}), r3 AS {_rows(3)}, r4 AS {_rows(4)}, r5 AS {_rows(5)}, r13 AS {_rows(13)}, ru AS ({_BY} ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CASE WHEN v IS NOT NULL AND ago IS NOT NULL THEN v END px, CASE WHEN v IS NOT NULL THEN ago END py, CASE WHEN whole THEN (v - rmedian_13) / nullif(1.4826 * list_median([abs(x - rmedian_13) FOR x IN vals]), 0) END robust_zscore FROM f),
q AS (SELECT *, count(px) OVER b n, sum(px) OVER b sx, sum(py) OVER b sy, sum(px * py) OVER b sxy, sum(px * px) OVER b sxx, sum(py * py) OVER b syy, (week_idx - max(CASE WHEN abs(robust_zscore) > 3 THEN week_idx END) OVER ({_BY} ROWS UNBOUNDED PRECEDING))::DOUBLE time_since_spike FROM p WINDOW b AS ({_BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN n >= 3 AND (n * sxx - sx * sx) * (n * syy - sy * sy) > 1e-9 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END seasonality_strength FROM q),
own AS (SELECT store, product, {', '.join(f'quantile_cont({c}, 0.5) own_{c}' for c in X.COMPOSITE)} FROM g GROUP BY ALL), every AS (SELECT {', '.join(f'quantile_disc({c}, 0.5) all_{c}' for c in X.COMPOSITE)} FROM g),
composite AS (SELECT store, product, week, week_idx, demand, scale_factor, {', '.join(f'coalesce({c}, own_{c}, all_{c}, 0.0) {c}' for c in X.COMPOSITE)}, CASE WHEN age <= 53 THEN 1.0 WHEN age <= 106 THEN 0.5 ELSE 0.25 END::DOUBLE sample_weight, y_h1, y_h2, y_h3 FROM g JOIN own USING (store, product), every)"""


@query(_COMPOSITE_SQL + f" SELECT store, product, week_idx, round(scale_factor, 4) scale_factor, {', '.join(f'round({c}, 3) + 0.0 {c}' for c in X.COMPOSITE)}, sample_weight, round(y_h1, 3) y_h1, round(y_h2, 3) y_h2, round(y_h3, 3) y_h3 FROM composite")
def b17_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the boosted model, filled by the series' and then by all rows' medians, with weights and targets."""
    rows = X.composite(demand_panel(spark, sf_dir), digits=3)
    return rows.select(*KEYS, "week_idx", F.round("scale_factor", 4).alias("scale_factor"), *X.COMPOSITE, "sample_weight", "y_h1", "y_h2", "y_h3")


_ROUTER_SQL = """SELECT {keys}, avg(demand) mean_demand, stddev_pop(demand) std_demand, stddev_pop(demand) / greatest(avg(demand), 0.01) cv, avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) zero_rate, count_if(demand > 0)::BIGINT nonzero_count,
  CASE WHEN count(*) > 2 THEN regr_slope(demand, -age::DOUBLE) ELSE 0 END trend_slope, CASE WHEN count(*) > 4 THEN stddev_pop(demand) FILTER (age <= 4) / greatest(avg(demand) FILTER (age <= 4), 0.01) - stddev_pop(demand) / greatest(avg(demand), 0.01) ELSE 0 END cv_change,
  CASE WHEN count_if(demand > 0) > 0 THEN count(*) / count_if(demand > 0) ELSE count(*)::DOUBLE END adi FROM {rows} WHERE age <= 12 GROUP BY {keys} HAVING count(*) > 1"""


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) age FROM panel), rf AS (" + _ROUTER_SQL.format(keys="store, product", rows="r") + """)
SELECT store, product, round(mean_demand, 6) mean_demand, round(std_demand, 6) std_demand, round(cv, 6) cv, round(zero_rate, 6) zero_rate, nonzero_count, round(trend_slope, 6) trend_slope, CAST(CASE WHEN trend_slope > 0.1 THEN 1 WHEN trend_slope < -0.1 THEN -1 ELSE 0 END AS INTEGER) trend_direction,
 CAST(mean_demand > 10 AS INTEGER) demand_level_high, CAST(mean_demand > 2 AND mean_demand <= 10 AS INTEGER) demand_level_medium, round(cv_change, 6) cv_change, round(adi, 6) adi, CAST(adi > 1.32 AS INTEGER) is_intermittent FROM rf""")
def b20_router_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve features of each series' last twelve weeks."""
    rows = L.router_features(demand_panel(spark, sf_dir), KEYS)
    exact = {"nonzero_count", "trend_direction", "demand_level_high", "demand_level_medium", "is_intermittent"}
    return rows.select(*KEYS, *(c if c in exact else F.round(c, 6).alias(c) for c in L.ROUTER))


def _learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite features with the competition's parts, as a table in the shared folder."""
    rows = splits.competition(X.composite(demand_panel(spark, sf_dir)))
    path = scratch(spark, "learning-rows")
    L.dealt(rows).write.parquet(path)
    return spark.read.parquet(path)


FEATURES = [*X.COMPOSITE, *KEYS]


def f13_boosted(spark: SparkSession, sf_dir: str, trees: int = 60) -> DataFrame:
    """Forecasts of one, two and three weeks ahead from each of the last eight weeks, in units, by a boosted model per horizon."""
    rows = _learning_rows(spark, sf_dir)
    models = {h: L.boosted(rows, FEATURES, h, trees) for h in L.HORIZONS}
    return L.predict(rows.where("part = 'test'"), FEATURES, models).select(*KEYS, "week_idx", F.round("scale_factor", 6).alias("scale_factor"), "h1", "h2", "h3")


def f14_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error in units of four settings of the boosted model over rolling folds, and the best."""
    errors = L.search(_learning_rows(spark, sf_dir), FEATURES, 1, {"depth": [3, 5], "step": [0.1, 0.3]})
    return L.best_setting(errors).select("depth", "step", F.round("mae", 6).alias("mae"), "best")


LAGS = (1, 2, 4, 8, 13, 26, 52)


def _lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each week and step: what is known at the week before, and the demand ``step`` weeks after that."""
    by = X.ordered()
    rows = demand_panel(spark, sf_dir)
    rows = rows.withColumns({f"lag_{k}": F.coalesce(F.lag("demand", k - 1).over(by), F.lit(0.0)) for k in LAGS} | {f"y_{h}": F.lead("demand", h).over(by) for h in L.HORIZONS})
    last = rows.agg(F.max("week_idx").alias("last"))
    steps = F.explode(F.array(*(F.struct(F.lit(h).alias("step"), F.col(f"y_{h}").alias("y")) for h in L.HORIZONS))).alias("s")
    rows = rows.crossJoin(F.broadcast(last)).select(*KEYS, "week", "week_idx", "last", *(f"lag_{k}" for k in LAGS), steps)  # one row
    angle = F.weekofyear(F.expr("date_add(week, 7 * s.step)")) * (2 * 3.141592653589793 / 52)
    rows = rows.select(*KEYS, "week_idx", "last", *(f"lag_{k}" for k in LAGS), *(F.log1p(f"lag_{k}").alias(f"log_{k}") for k in LAGS), F.sin(angle).alias("season_sin"), F.cos(angle).alias("season_cos"), "s.step", "s.y")
    path = scratch(spark, "lagged-rows")
    L.dealt(rows).write.parquet(path)
    return spark.read.parquet(path)


#: The last three weeks are forecast from the week before them; weeks whose targets reach into them aren't learned from.
_KNOWN, _AHEAD = "week_idx >= 52 and week_idx + step <= last - 3", "week_idx = last - 3"


def f11_quantile_forest(spark: SparkSession, sf_dir: str, trees: int = 100) -> DataFrame:
    """Quantiles of a forest's trees for the last three weeks of each series."""
    rows = _lagged(spark, sf_dir)
    features = [*(f"lag_{k}" for k in LAGS), "season_sin", "season_cos", "step"]
    out = L.forest_quantiles(rows.where(_KNOWN), rows.where(_AHEAD), features, "y", [*KEYS, "step"], trees)
    return out.select(*KEYS, "step", "tau", F.round("value", 6).alias("value"))


def f11_pooled_forest(spark: SparkSession, sf_dir: str, trees: int = 50) -> DataFrame:
    """Quantiles of the training weeks that share leaves with the last three weeks of each series."""
    rows = _lagged(spark, sf_dir)
    features = [*(f"lag_{k}" for k in LAGS), "season_sin", "season_cos", "step"]
    return L.forest_quantiles(rows.where(_KNOWN), rows.where(_AHEAD), features, "y", [*KEYS, "step"], trees, pooled=True)


def f10_count_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative binomial (or Poisson) quantiles of the last three weeks, around a pooled Poisson regression, with each series' own dispersion."""
    rows = _lagged(spark, sf_dir)
    features = [*(f"log_{k}" for k in LAGS), "season_sin", "season_cos", "step"]
    known = rows.where(_KNOWN)
    model = L.count_regression(known, features, "y").setPredictionCol("mu")
    sizes = L.dispersions(model.transform(L.assembled(known, features)), KEYS, "mu", "y")
    ahead = model.transform(L.assembled(rows.where(_AHEAD), features)).select(*KEYS, "step", "mu").join(sizes, KEYS, "left")
    return L.count_quantiles(ahead, [*KEYS, "step"])


_LEVELS = "[0.01,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]"


@query(f""", r AS (SELECT store, product, avg(demand) mu, var_samp(demand) v FROM panel GROUP BY ALL), z AS (SELECT *, CASE WHEN v > mu THEN mu * mu / (v - mu) END size FROM r),
x AS (SELECT store, product, x, sum(CASE WHEN size IS NULL THEN exp(x * ln(mu) - mu - lgamma(x + 1)) ELSE exp(lgamma(x + size) - lgamma(size) - lgamma(x + 1) + size * ln(size / (size + mu)) + x * ln(mu / (size + mu))) END) OVER (PARTITION BY store, product ORDER BY x) cdf FROM z, (SELECT unnest(range(0, (SELECT CAST(max(mu) * 30 + 100 AS BIGINT) FROM r))) x))
SELECT store, product, tau, CAST(count(*) FILTER (cdf < tau - 1e-9) AS DOUBLE) AS value FROM x, (SELECT unnest({_LEVELS}) tau) GROUP BY ALL""")
def f10_negative_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative binomial quantiles by the mean and variance of each series; Poisson where the variance isn't greater."""
    r = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg("demand").alias("mu"), F.var_samp("demand").alias("v"))
    return L.count_quantiles(r.select(*KEYS, "mu", F.when(F.col("v") > F.col("mu"), F.col("mu") * F.col("mu") / (F.col("v") - F.col("mu"))).alias("size")), KEYS)


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each model's first week in each fold, ordered up to its 5/6 quantile: 0.2 a unit over, 1.0 a unit short."""
    at = lambda t: F.max(F.when(F.round("tau", 4) == t, F.col("value")))
    rows = _scored(spark, sf_dir).where("step = 1").groupBy("model", *FOLD).agg(F.first("y").alias("y"), (at(0.8) + (at(0.9) - at(0.8)) * (0.8333 - 0.8) / 0.1).alias("q"))
    return rows.withColumn("cost", F.when(F.col("q") < F.col("y"), F.col("y") - F.col("q")).otherwise(0.2 * (F.col("q") - F.col("y"))))


def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the weeks before each fold and the model that was cheapest in it."""
    train = _train_test(spark, sf_dir)[0]
    return L.router_features(train, FOLD).join(L.Router.cheapest(_costs(spark, sf_dir), FOLD), FOLD)


def j18_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each series in the last fold, chosen by a forest that learned from the folds before."""
    path = scratch(spark, "routing")
    _routing(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("fold_idx")).first()[0]
    out = L.Router(L.ROUTER).fit(rows.where(F.col("fold_idx") < last)).predict(rows.where(F.col("fold_idx") == last), KEYS)
    weights = F.array_join(F.transform(F.map_entries("weights"), lambda e: F.concat_ws(":", e["key"], F.format_number(e["value"], 6))), ",")
    return out.select(*KEYS, "selected_model", F.round("confidence", 6).alias("confidence"), "use_ensemble", weights.alias("weights"))


def j18_router_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the router over the folds, each left out in turn, and the importance of its features."""
    path = scratch(spark, "routing")
    _routing(spark, sf_dir).where("fold_idx >= 8").write.parquet(path)
    rows = spark.read.parquet(path)
    router = L.Router(L.ROUTER, trees=40)
    a = router.cross_validate(rows, "fold_idx")
    mean = sum(a) / len(a)
    out = [("mean_accuracy", mean), ("std_accuracy", (sum((x - mean) ** 2 for x in a) / len(a)) ** 0.5), ("min_accuracy", min(a)), ("max_accuracy", max(a))]
    return spark.createDataFrame([*out, *((f"importance_{n}", v) for n, v in router.fit(rows).importances())], "metric string, value double")


@query(_FOLDS_SQL + ", a AS (SELECT *, row_number() OVER (PARTITION BY store, product, fold_idx ORDER BY week_idx DESC) age FROM train), rf AS (" + _ROUTER_SQL.format(keys="store, product, fold_idx", rows="a") + ") SELECT store, product, fold_idx, round(mean_demand, 6) mean_demand, round(cv, 6) cv, round(cv_change, 6) cv_change, round(adi, 6) adi FROM rf")
def j18_routing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the router is told of each series at each fold's cut."""
    return L.router_features(_train_test(spark, sf_dir)[0], FOLD).select(*FOLD, *(F.round(c, 6).alias(c) for c in ("mean_demand", "cv", "cv_change", "adi")))


STRATEGY = ["final_rank", "final_cost", "cost_volatility", "rank_volatility", "cost_trend", "rank_trend", "max_cost", "cost_range", "total_entries", "avg_applies"]
_STRATEGY_SQL = _BOARD_SQL + """, en AS (SELECT c_name AS name, CAST(year(o_orderdate) AS INTEGER) AS wk, count(*) entries, count(DISTINCT o_orderdate::DATE) applies FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
cu AS (SELECT r.*, entries, applies, sum(cost) OVER (PARTITION BY name ORDER BY wk) total FROM r JOIN en USING (name, wk)),
st AS (SELECT name, arg_max(rk, wk)::DOUBLE final_rank, arg_max(total, wk) final_cost, stddev_pop(cost) / avg(cost) cost_volatility, stddev_pop(rk) rank_volatility, CASE WHEN count(*) > 1 THEN regr_slope(cost, wk::DOUBLE) ELSE 0 END cost_trend, CASE WHEN count(*) > 1 THEN regr_slope(rk, wk::DOUBLE) ELSE 0 END rank_trend,
  max(cost) max_cost, max(cost) - min(cost) cost_range, sum(entries)::DOUBLE total_entries, avg(applies) avg_applies FROM cu GROUP BY name)"""


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    entries = orders.groupBy(F.col("c_name").alias("name"), F.year("o_orderdate").alias("wk")).agg(F.count("*").alias("entries"), F.count_distinct(F.to_date("o_orderdate")).alias("applies"))
    rows = _board(spark, sf_dir).join(entries, ["name", "wk"]).withColumn("total", F.sum("cost").over(Window.partitionBy("name").orderBy("wk")))
    cost, rank, week, more = F.col("cost"), F.col("rk").cast("double"), F.col("wk").cast("double"), F.count("*") > 1
    c = {"final_rank": F.max_by(rank, "wk"), "final_cost": F.max_by("total", "wk"), "cost_volatility": F.stddev_pop(cost) / F.avg(cost), "rank_volatility": F.stddev_pop(rank), "cost_trend": F.when(more, F.regr_slope(cost, week)).otherwise(0.0)}
    c |= {"rank_trend": F.when(more, F.regr_slope(rank, week)).otherwise(0.0), "max_cost": F.max(cost), "cost_range": F.max(cost) - F.min(cost), "total_entries": F.sum("entries").cast("double"), "avg_applies": F.avg("applies")}
    return rows.groupBy("name").agg(*(v.alias(n) for n, v in c.items()))


@query(_STRATEGY_SQL + " SELECT name, " + ", ".join(f"round({c}, 3) + 0.0 {c}" for c in STRATEGY) + ", CASE WHEN avg_applies > 2 THEN 'Heavy Optimizer' WHEN avg_applies > 1 THEN 'Active Optimizer' ELSE 'Single Shot' END submission_type FROM st", panel=False)
def m6_strategy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten features of each competitor's record, and how it submits."""
    kind = F.when(F.col("avg_applies") > 2, "Heavy Optimizer").when(F.col("avg_applies") > 1, "Active Optimizer").otherwise("Single Shot")
    return _strategies(spark, sf_dir).select("name", *((F.round(c, 3) + 0.0).alias(c) for c in STRATEGY), kind.alias("submission_type"))


def m6_strategy_clusters(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """Competitors by cluster, and the cluster's archetype from its mean final rank and volatility."""
    rows = L.clusters(_strategies(spark, sf_dir).fillna(0.0, STRATEGY), STRATEGY, k)
    means = rows.groupBy("cluster").agg(F.avg("final_rank").alias("avg_final_rank"), F.avg("cost_volatility").alias("avg_cost_volatility"), F.count("*").alias("n_competitors"))
    n = F.lit(rows.count())
    kind = F.when(F.col("avg_final_rank") <= n * 0.3, "Top Performers").when(F.col("avg_cost_volatility") > 0.3, "High Risk").when(F.col("avg_cost_volatility") < 0.1, "Conservative").otherwise("Moderate")
    return rows.select("name", "cluster").join(F.broadcast(means.withColumn("strategy_type", kind)), "cluster").select("name", "cluster", "strategy_type", "n_competitors", F.round("avg_final_rank", 4).alias("avg_final_rank"), F.round("avg_cost_volatility", 6).alias("avg_cost_volatility"))  # k rows


for _f in (f13_boosted, f14_search, f11_quantile_forest, f11_pooled_forest, f10_count_regression, j18_router, j18_router_validation, m6_strategy_clusters):
    query()(_f)  # learned: tests hold them against brute force and planted signals
