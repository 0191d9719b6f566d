"""Registered queries: per-series features, transforms, and temporal splits, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .functions import transforms as T
from .operators import splits
from .plans.bindings import KEYS, demand_panel, read
from .registry import query

BY = "PARTITION BY store, product ORDER BY week_idx"


@query("""SELECT store, product, week_idx, CAST(weekofyear(week) AS INTEGER) iso_week, CAST(month(week) AS INTEGER) AS "month", CAST(quarter(week) AS INTEGER) AS "quarter", CAST(isodow(week) - 1 AS INTEGER) dow,
  CAST(day(week) = 1 AS INTEGER) month_start, CAST(week = last_day(week) AS INTEGER) month_end, CAST(week = date_trunc('quarter', week) AS INTEGER) quarter_start,
  CAST(week = date_trunc('quarter', week) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS INTEGER) quarter_end,
  round(sin(weekofyear(week) * 2 * pi() / 52), 6) + 0.0 week_sin, round(cos(weekofyear(week) * 2 * pi() / 52), 6) + 0.0 week_cos FROM panel""")
def b1_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.calendar(F.col("week"))
    c |= {n: F.round(c[n], 6) + 0.0 for n in ("week_sin", "week_cos")}
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", *(v.alias(n) for n, v in c.items()))


@query(f"SELECT store, product, week_idx, {', '.join(f'lag(demand, {k}) OVER ({BY}) lag_{k}' for k in (1, 2, 4, 8, 13, 52))} FROM panel")
def b2_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_columns(demand_panel(spark, sf_dir), X.lags("demand")).drop("week", "demand", "in_stock")


def _rolling_sql(w: int) -> str:
    o = f"OVER ({BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"round(avg(demand) {o}, 6) mean_{w}, round(stddev_samp(demand) {o}, 6) std_{w}, round(stddev_samp(demand) {o} / (avg(demand) {o} + 1e-6), 6) cv_{w}, round(min(demand) {o}, 6) min_{w}, round(max(demand) {o}, 6) max_{w}, round(quantile_cont(demand, 0.5) {o}, 6) median_{w}"


@query(f"SELECT store, product, week_idx, {', '.join(_rolling_sql(w) for w in (4, 8, 13, 26))} FROM panel")
def b3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.rolled(demand_panel(spark, sf_dir).select(*KEYS, "week_idx", "demand"), "demand")
    return rows.select(*KEYS, "week_idx", *(F.round(c, 6).alias(c) for c in rows.columns if c not in (*KEYS, "week_idx", "demand")))


@query(f"SELECT store, product, week_idx, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(demand, CAST(week_idx AS DOUBLE)) OVER w END, 4) + 0.0 slope_13 FROM panel WINDOW w AS ({BY} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")
def b4_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", (F.round(X.slope("demand"), 4) + 0.0).alias("slope_13"))


_ZERO = ", ".join(f"round(avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) OVER ({BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) zero_rate_{w}" for w in (4, 8, 13))


@query(f""", s AS (SELECT *, CASE WHEN demand > 0 THEN week_idx END AS sold FROM panel)
SELECT store, product, week_idx, {_ZERO}, week_idx - max(sold) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) weeks_since_sale,
 round(CASE WHEN count(sold) OVER w > 1 THEN (max(sold) OVER w - min(sold) OVER w) / (count(sold) OVER w - 1.0) END, 6) adi_gap FROM s WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""")
def b5_intermittency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.intermittency("demand")
    c = {n: v if n == "weeks_since_sale" else F.round(v, 6) for n, v in c.items()}
    return X.with_columns(demand_panel(spark, sf_dir), c).drop("week", "demand", "in_stock")


@query("SELECT DISTINCT week_idx, " + ", ".join(f"round({n}(dayofyear(week) * (2 * pi() / 365.25) * {k}), 6) {n}_{k}" for k in (1, 2, 3) for n in ("sin", "cos")) + " FROM panel")
def b6_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = demand_panel(spark, sf_dir).select("week", "week_idx").distinct()
    return X.with_columns(weeks, X.fourier(F.col("week")), 6).drop("week")


@query(f""", f AS (SELECT p.*, count(*) OVER (PARTITION BY store, product) n, lag(demand, 1) OVER ({BY}) lag_1, lag(demand, 52) OVER ({BY}) lag_52, avg(demand) OVER ({BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) mean_13 FROM panel p)
SELECT f.store, f.product, week_idx, lag_1, lag_52, round(mean_13, 6) mean_13, n_name AS region_name FROM f JOIN nation ON n_nationkey = (f.store * 20 + f.product) % 25 WHERE n >= 52 AND lag_52 IS NOT NULL""")
def b7_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags and shifted means joined to a dimension, for series with a year of history."""
    panel = demand_panel(spark, sf_dir)
    c = {"n": F.count("*").over(Window.partitionBy(*KEYS)), **X.lags("demand", (1, 52)), "mean_13": F.avg("demand").over(X.ordered().rowsBetween(-13, -1))}
    rows = X.with_columns(panel, c).where("n >= 52 and lag_52 is not null")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("region_name"))
    return rows.join(nations, (F.col("store") * 20 + F.col("product")) % 25 == F.col("n_nationkey")).select(*KEYS, "week_idx", "lag_1", "lag_52", F.round("mean_13", 6).alias("mean_13"), "region_name")


@query("SELECT store, product, week_idx, CASE WHEN in_stock THEN demand END effective FROM panel")
def b8_effective_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", X.effective().alias("effective"))


_SCALE_SQL = f""", e AS (SELECT *, CASE WHEN in_stock THEN demand END y FROM panel),
scaled AS (SELECT *, greatest(1.0, 53 * coalesce(CASE WHEN count(y) OVER y1 >= 45 THEN avg(y) OVER y1 END, avg(y) OVER y2, 0.0)) scale FROM e
  WINDOW y1 AS ({BY} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING), y2 AS ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, y / scale * 1000 AS v FROM scaled)"""


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("y", X.effective())
    rows = rows.withColumn("scale", X.scale_factor("y"))
    return rows.withColumn("v", F.col("y") / F.col("scale") * 1000)


@query(_SCALE_SQL + " SELECT store, product, week_idx, round(scale, 6) AS scale FROM scaled")
def b9_scale_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select(*KEYS, "week_idx", F.round("scale", 6).alias("scale"))


@query(_SCALE_SQL + " SELECT store, product, week_idx, round(v, 6) lag_0, " + ", ".join(f"round(lag(v, {k}) OVER ({BY}), 6) lag_{k}" for k in (1, 2, 3, 51, 52, 53)) + " FROM z")
def b10_scaled_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {"lag_0": F.col("v"), **X.lags("v", (1, 2, 3, 51, 52, 53))}
    return X.with_columns(_scaled(spark, sf_dir), c, 6).select(*KEYS, "week_idx", *c)


@query(f"""SELECT store, product, week_idx, round(avg(demand) OVER w3, 6) mean_3, round(quantile_cont(demand, 0.5) OVER w5, 6) median_5, round(stddev_samp(demand) OVER w13, 6) std_13,
 round(quantile_cont(demand, 0.75) OVER w13 - quantile_cont(demand, 0.25) OVER w13, 6) iqr_13, round(demand - lag(demand, 1) OVER w, 6) delta_1, round(demand - lag(demand, 5) OVER w, 6) delta_5
 FROM panel WINDOW w AS ({BY}), w3 AS ({BY} ROWS 2 PRECEDING), w5 AS ({BY} ROWS 4 PRECEDING), w13 AS ({BY} ROWS 12 PRECEDING)""")
def b11_b12_rolling_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = lambda w: X.ordered().rowsBetween(-(w - 1), 0)
    q = lambda p, w: F.percentile("demand", F.lit(p)).over(over(w))
    c = {"mean_3": F.avg("demand").over(over(3)), "median_5": q(0.5, 5), "std_13": F.stddev_samp("demand").over(over(13)), "iqr_13": q(0.75, 13) - q(0.25, 13)}
    c |= {f"delta_{k}": F.col("demand") - F.lag("demand", k).over(X.ordered()) for k in (1, 5)}
    return X.with_columns(demand_panel(spark, sf_dir), c, 6).select(*KEYS, "week_idx", *c)


@query(f""" SELECT store, product, week_idx, {', '.join(f"round(sum(demand * power({n + 1}.0 / {n - 1}.0, week_idx)) OVER w / sum(power({n + 1}.0 / {n - 1}.0, week_idx)) OVER w, 5) ewm_{n}" for n in (5, 10))} FROM panel WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""")
def b11_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted means of the whole history, at spans of 5 and 10 weeks."""
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", *(F.round(X.weighted_recent("demand", n), 5).alias(f"ewm_{n}") for n in (5, 10)))


@query(f""", l AS (SELECT *, lag(demand, 52) OVER ({BY}) ago FROM panel), s AS (SELECT *, avg(demand) OVER ({BY} ROWS BETWEEN 55 PRECEDING AND 49 PRECEDING) last_year,
 count(ago) OVER w n, sum(CASE WHEN ago IS NOT NULL THEN demand END) OVER w sx, sum(ago) OVER w sy, sum(demand * ago) OVER w sxy, sum(CASE WHEN ago IS NOT NULL THEN demand * demand END) OVER w sxx, sum(ago * ago) OVER w syy
 FROM l WINDOW w AS ({BY} ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING))
SELECT store, product, week_idx, round(last_year, 6) last_year, round(CASE WHEN n >= 3 AND (n * sxx - sx * sx) * (n * syy - sy * sy) > 1e-9 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 6) strength FROM s""")
def b13_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("_year_ago", F.lag("demand", 52).over(X.ordered()))
    last_year = F.avg("demand").over(X.ordered().rowsBetween(-55, -49))
    return rows.select(*KEYS, "week_idx", F.round(last_year, 6).alias("last_year"), F.round(X.seasonal_strength("demand"), 6).alias("strength"))


@query(f""", m AS (SELECT *, quantile_cont(demand, 0.5) OVER ({BY} ROWS 12 PRECEDING) AS med, row_number() OVER ({BY}) rn FROM panel),
d AS (SELECT a.store, a.product, a.week_idx, a.demand, a.med, quantile_cont(abs(b.demand - a.med), 0.5) mad FROM m a JOIN m b ON a.store = b.store AND a.product = b.product AND b.rn BETWEEN a.rn - 12 AND a.rn GROUP BY ALL),
z AS (SELECT *, (demand - med) / (1.4826 * mad + 1e-6) z FROM d)
SELECT store, product, week_idx, round(z, 4) robust_z, week_idx - max(CASE WHEN abs(z) > 3 THEN week_idx END) OVER ({BY} ROWS UNBOUNDED PRECEDING) weeks_since_spike FROM z""")
def b14_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.with_spikes(demand_panel(spark, sf_dir), "demand").withColumnRenamed("robust_z", "z")
    since = F.col("week_idx") - F.last(F.when(F.abs("z") > 3, F.col("week_idx")), True).over(X.ordered().rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*KEYS, "week_idx", F.round("z", 4).alias("robust_z"), since.alias("weeks_since_spike"))


@query(""", e AS (SELECT *, CASE WHEN in_stock THEN demand END y FROM panel), m AS (SELECT store, product, quantile_cont(y, 0.5) AS med FROM e GROUP BY ALL), g AS (SELECT quantile_cont(y, 0.5) gm FROM e)
SELECT e.store, e.product, week_idx, coalesce(y, med, gm) filled FROM e JOIN m USING (store, product), g""")
def b15_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("y", X.effective())
    own = rows.groupBy(*KEYS).agg(F.percentile("y", F.lit(0.5)).alias("own"))
    overall = rows.agg(F.percentile("y", F.lit(0.5)).alias("overall"))
    return rows.join(own, KEYS).crossJoin(F.broadcast(overall)).select(*KEYS, "week_idx", F.coalesce("y", "own", "overall").alias("filled"))  # one row


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) rn FROM panel) SELECT store, product, week_idx, CASE WHEN rn <= 53 THEN 1.0 WHEN rn <= 106 THEN 0.5 ELSE 0.25 END::DOUBLE weight FROM r")
def b16_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("week_idx")))
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.when(age <= 53, 1.0).when(age <= 106, 0.5).otherwise(0.25).alias("weight"))


@query(_SCALE_SQL + f" SELECT store, product, week_idx, {', '.join(f'round(lead(v, {h}) OVER ({BY}), 6) y_h{h}' for h in (1, 2, 3))} FROM z")
def b19_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir).select(*KEYS, "week_idx", *(F.round(F.lead("v", h).over(X.ordered()), 6).alias(f"y_h{h}") for h in (1, 2, 3)))


@query(f"""SELECT store, product, week_idx, round(avg(demand) OVER w4, 6) mean_4, round(stddev_samp(demand) OVER w4, 6) std_4, round(avg(demand) OVER (PARTITION BY store, product, weekofyear(week)), 6) same_week_mean,
 round(avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) OVER w4, 6) zero_share_4 FROM panel WINDOW w4 AS ({BY} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def b21_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = X.ordered().rowsBetween(-4, -1)
    c = {"mean_4": F.avg("demand").over(over), "std_4": F.stddev_samp("demand").over(over), "same_week_mean": F.avg("demand").over(Window.partitionBy(*KEYS, F.weekofyear("week"))), "zero_share_4": F.avg((F.col("demand") == 0).cast("double")).over(over)}
    return X.with_columns(demand_panel(spark, sf_dir), c, 6).select(*KEYS, "week_idx", *c)


@query(""", t AS (SELECT store, product, ['identity','log','log1p','sqrt','cbrt'][(store + product) % 5 + 1] AS transform FROM (SELECT DISTINCT store, product FROM panel)),
z AS (SELECT p.*, transform, CASE transform WHEN 'identity' THEN demand WHEN 'log' THEN ln(greatest(demand, 1e-6)) WHEN 'log1p' THEN ln(1 + demand) WHEN 'sqrt' THEN sqrt(demand) ELSE cbrt(demand) END z FROM panel p JOIN t USING (store, product))
SELECT store, product, week_idx, transform, round(z, 6) z, round(CASE transform WHEN 'identity' THEN z WHEN 'log' THEN exp(z) WHEN 'log1p' THEN exp(z) - 1 WHEN 'sqrt' THEN z * z ELSE z * z * z END, 4) back FROM z""")
def b23_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("identity", "log", "log1p", "sqrt", "cbrt"))), (F.col("store") + F.col("product")) % 5 + 1)
    rows = demand_panel(spark, sf_dir).withColumn("transform", name)
    rows = rows.withColumn("z", T.apply(F.col("transform"), F.col("demand"), T.FORWARD))
    return rows.select(*KEYS, "week_idx", "transform", F.round("z", 6).alias("z"), F.round(T.apply(F.col("transform"), F.col("z"), T.INVERSE), 4).alias("back"))


@query(""", c AS (SELECT store, product, t.n AS transform, CASE t.n WHEN 'identity' THEN demand WHEN 'log' THEN ln(greatest(demand, 1e-6)) WHEN 'log1p' THEN ln(1 + demand) WHEN 'sqrt' THEN sqrt(demand) ELSE cbrt(demand) END z
 FROM panel, (SELECT unnest(['identity','log','log1p','sqrt','cbrt']) n) t WHERE demand > 0), v AS (SELECT store, product, transform, stddev_pop(z) / abs(avg(z)) cv FROM c GROUP BY ALL HAVING abs(avg(z)) > 1e-9)
SELECT store, product, arg_min(transform, (round(cv, 9), transform)) AS transform, round(min(cv), 6) cv FROM v GROUP BY ALL""")
def b24_best_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_by_variation(demand_panel(spark, sf_dir), KEYS).withColumn("cv", F.round("cv", 6))


@query(""", s AS (SELECT store, product, sum(demand) rate, avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END) zero_share FROM panel GROUP BY ALL), q AS (SELECT quantile_cont(rate, 1.0 / 3) a, quantile_cont(rate, 2.0 / 3) b, quantile_cont(zero_share, 0.5) c FROM s)
SELECT store, product, CASE WHEN rate <= a THEN 'low' WHEN rate <= b THEN 'mid' ELSE 'high' END rate_bin, CASE WHEN zero_share <= c THEN 'dense' ELSE 'sparse' END zero_bin FROM s, q""")
def b26_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.sum("demand").alias("rate"), F.avg((F.col("demand") == 0).cast("double")).alias("zero_share"))
    q = s.agg(F.percentile("rate", F.lit(1.0 / 3)).alias("a"), F.percentile("rate", F.lit(2.0 / 3)).alias("b"), F.percentile("zero_share", F.lit(0.5)).alias("c"))
    return s.crossJoin(F.broadcast(q)).select(*KEYS, F.when(F.col("rate") <= F.col("a"), "low").when(F.col("rate") <= F.col("b"), "mid").otherwise("high").alias("rate_bin"), F.when(F.col("zero_share") <= F.col("c"), "dense").otherwise("sparse").alias("zero_bin"))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) rn FROM panel WHERE in_stock)
SELECT store, product, max(demand) = 0 AND count(*) = 10 AS dormant FROM r WHERE rn <= 10 GROUP BY ALL""")
def b27_dormant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose last ten in-stock weeks sold nothing."""
    age = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("week_idx")))
    rows = demand_panel(spark, sf_dir).where("in_stock").withColumn("rn", age).where("rn <= 10")
    return rows.groupBy(*KEYS).agg(((F.max("demand") == 0) & (F.count("*") == 10)).alias("dormant"))


@query(""", d AS (SELECT store, product, stddev_samp(demand) sd FROM panel WHERE in_stock GROUP BY ALL)
SELECT p.store, p.product, week_idx, demand lower_target, round(CASE WHEN in_stock THEN demand ELSE demand + greatest(2.0 * sd, 1.0) END, 6) upper_target, CAST(NOT in_stock AS INTEGER) censored, CASE WHEN in_stock THEN 1.0 ELSE 0.5 END::DOUBLE weight FROM panel p JOIN d USING (store, product)""")
def b28_b29_interval_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir)
    sd = F.stddev_samp(X.effective()).over(Window.partitionBy(*KEYS))
    upper = F.when(F.col("in_stock"), F.col("demand")).otherwise(F.col("demand") + F.greatest(2.0 * sd, F.lit(1.0)))
    return rows.select(*KEYS, "week_idx", F.col("demand").alias("lower_target"), F.round(upper, 6).alias("upper_target"), (~F.col("in_stock")).cast("int").alias("censored"), F.when(F.col("in_stock"), 1.0).otherwise(0.5).alias("weight"))


@query(""", d AS (SELECT store, product, avg(demand) m, stddev_samp(demand) sd FROM panel WHERE in_stock GROUP BY ALL),
l AS (SELECT p.*, m, CASE WHEN in_stock THEN demand ELSE demand + greatest(2.0 * sd, 1.0) END hi, CASE WHEN in_stock THEN 1.0 ELSE 0.5 END w FROM panel p JOIN d USING (store, product))
SELECT store, product, round(sum(w * CASE WHEN m < demand THEN 0.833 * (demand - m) WHEN m > hi THEN 0.167 * (m - hi) ELSE 0 END) / sum(w), 6) interval_loss FROM l GROUP BY ALL""")
def b30_interval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by = demand_panel(spark, sf_dir), Window.partitionBy(*KEYS)
    rows = rows.select(*KEYS, "demand", "in_stock", F.avg(X.effective()).over(by).alias("m"), F.stddev_samp(X.effective()).over(by).alias("sd"))
    hi = F.when(F.col("in_stock"), F.col("demand")).otherwise(F.col("demand") + F.greatest(2.0 * F.col("sd"), F.lit(1.0)))
    w = F.when(F.col("in_stock"), 1.0).otherwise(0.5)
    loss = F.when(F.col("m") < F.col("demand"), 0.833 * (F.col("demand") - F.col("m"))).when(F.col("m") > hi, 0.167 * (F.col("m") - hi)).otherwise(0.0)
    return rows.groupBy(*KEYS).agg(F.round(F.sum(w * loss) / F.sum(w), 6).alias("interval_loss"))


@query("""SELECT store, product, CASE WHEN avg(demand) = 0 THEN 'zero' WHEN avg(demand) < 42 THEN 'low' WHEN avg(demand) < 44 THEN 'medium' ELSE 'high' END segment, round(avg(demand), 6) mean, round(stddev_samp(demand), 6) sd,
 round(avg(abs(demand - m)), 6) mae, round(sqrt(avg((demand - m) * (demand - m))), 6) rmse FROM (SELECT *, avg(demand) OVER (PARTITION BY store, product) m FROM panel) GROUP BY store, product""")
def b31_b32_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).withColumn("m", F.avg("demand").over(Window.partitionBy(*KEYS)))
    mean, e = F.avg("demand"), F.col("demand") - F.col("m")
    segment = F.when(mean == 0, "zero").when(mean < 42, "low").when(mean < 44, "medium").otherwise("high")
    return rows.groupBy(*KEYS).agg(segment.alias("segment"), F.round(mean, 6).alias("mean"), F.round(F.stddev_samp("demand"), 6).alias("sd"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query(f""", r AS (SELECT *, row_number() OVER ({BY}) rn, count(*) OVER (PARTITION BY store, product) n FROM panel), f AS (SELECT r.*, CAST(k AS INTEGER) fold_idx, n - (12 - k) - 2 AS cut FROM r, (SELECT unnest(range(12)) k))
SELECT store, product, week_idx, fold_idx, CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS role, CAST(CASE WHEN rn > cut THEN rn - cut END AS INTEGER) step FROM f WHERE rn <= cut + 3 AND cut >= 52""")
def c1_rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.rolling_origin(demand_panel(spark, sf_dir)).select(*KEYS, "week_idx", "fold_idx", "role", "step")


@query(""", c AS (SELECT max(week_idx) AS mx, count(DISTINCT week_idx) n FROM panel)
SELECT store, product, week_idx, CASE WHEN week_idx > mx - 18 THEN 'test' WHEN week_idx > mx - 18 - floor((n - 18) * 0.1) THEN 'val' ELSE 'train' END part FROM panel, c""")
def c2_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological(demand_panel(spark, sf_dir)).select(*KEYS, "week_idx", "part")


@query(""", c AS (SELECT max(week_idx) mx FROM panel) SELECT store, product, week_idx, CAST(k AS INTEGER) AS fold, CASE WHEN week_idx <= mx - k * 3 - 3 THEN 'train' ELSE 'test' END part FROM panel, c, (SELECT unnest(range(8)) k) WHERE week_idx <= mx - k * 3""")
def c3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.blocks_from_end(demand_panel(spark, sf_dir)).select(*KEYS, "week_idx", "fold", "part")


@query(""", c AS (SELECT max(week) mx FROM panel) SELECT store, product, week_idx, CASE WHEN week >= mx - 49 THEN 'test' WHEN week BETWEEN mx - 49 - 364 AND mx - 364 THEN 'early_stop' ELSE 'train' END part FROM panel, c""")
def c4_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.competition(demand_panel(spark, sf_dir)).select(*KEYS, "week_idx", "part")
