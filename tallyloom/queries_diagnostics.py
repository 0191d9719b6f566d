"""Registered queries: information in quantile bins, losses at interpolated levels, calibration by three methods, serial diagnostics, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .operators import evaluation, scoring, statistics
from .operators import information as I
from .operators.forecasts import LEVELS
from .plans.bindings import KEYS, demand_panel
from .queries_models import _SCORED_SQL, MODEL, _scored
from .registry import query

_BY = "PARTITION BY store, product ORDER BY week_idx"
_BINNED_SQL = f""", src AS (SELECT store, product, week_idx, demand y, coalesce(lag(demand, 1) OVER ({_BY}), 0) lag_1, coalesce(lag(demand, 2) OVER ({_BY}), 0) lag_2, month(week)::DOUBLE AS month, CAST(in_stock AS INTEGER)::DOUBLE in_stock, count(*) OVER (PARTITION BY store, product) n FROM panel),
lg AS (SELECT store, product, week_idx, unnest(['y', 'lag_1', 'lag_2', 'month', 'in_stock']) feature, unnest([y, lag_1, lag_2, month, in_stock]) v FROM src WHERE n >= 16),
ed AS (SELECT store, product, feature, quantile_cont(v, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]) q FROM lg GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY store, product, feature ORDER BY v) + (count(*) OVER (PARTITION BY store, product, feature, v) - 1) / 2 r FROM lg),
bn AS (SELECT k.store, k.product, k.feature, week_idx, CAST(CASE WHEN len(edges) < 3 THEN floor(r / ((most + 1) / 8)) ELSE len([e FOR e IN edges IF e <= v]) - 1 END AS INTEGER) b
  FROM (SELECT *, max(r) OVER (PARTITION BY store, product, feature) most FROM rk) k JOIN (SELECT store, product, feature, list_distinct([round(e, 9) FOR e IN q]) edges FROM ed) e ON e.store = k.store AND e.product = k.product AND e.feature = k.feature),
cl AS (SELECT x.store, x.product, x.feature, x.b x, y.b y, count(*) c FROM bn x JOIN bn y ON y.store = x.store AND y.product = x.product AND y.week_idx = x.week_idx AND y.feature = 'y' AND x.feature <> 'y' GROUP BY ALL),
mi AS (SELECT store, product, feature, sum(c / n * log2(c * n / (nx * ny))) mi FROM (SELECT *, sum(c) OVER (PARTITION BY store, product, feature) n, sum(c) OVER (PARTITION BY store, product, feature, x) nx, sum(c) OVER (PARTITION BY store, product, feature, y) ny FROM cl) GROUP BY ALL)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, product, feature, mi: what may tell of demand (y), in eight quantile bins; series of 16 weeks and more."""
    by = X.ordered()
    wide = {"y": F.col("demand"), "lag_1": F.coalesce(F.lag("demand", 1).over(by), F.lit(0.0)), "lag_2": F.coalesce(F.lag("demand", 2).over(by), F.lit(0.0)), "month": F.month("week").cast("double"), "in_stock": F.col("in_stock").cast("double")}
    return I.told(demand_panel(spark, sf_dir).select(*KEYS, *(c.alias(n) for n, c in wide.items())), KEYS, "y", [c for c in wide if c != "y"], ("lag_1", "in_stock"))


@query(_BINNED_SQL + """, cj AS (SELECT a.store, a.product, a.b x1, s.b x2, y.b y, count(*) c FROM bn a JOIN bn s ON s.store = a.store AND s.product = a.product AND s.week_idx = a.week_idx AND s.feature = 'in_stock' JOIN bn y ON y.store = a.store AND y.product = a.product AND y.week_idx = a.week_idx AND y.feature = 'y' WHERE a.feature = 'lag_1' GROUP BY ALL),
mj AS (SELECT store, product, sum(c / n * log2(c * n / (nx * ny))) m12 FROM (SELECT *, sum(c) OVER (PARTITION BY store, product) n, sum(c) OVER (PARTITION BY store, product, x1, x2) nx, sum(c) OVER (PARTITION BY store, product, y) ny FROM cj) GROUP BY ALL),
p AS (SELECT a.store, a.product, a.mi m1, b.mi m2, m12, least(a.mi, b.mi) red FROM mi a JOIN mi b ON a.store = b.store AND a.product = b.product AND a.feature = 'lag_1' AND b.feature = 'in_stock' JOIN mj ON mj.store = a.store AND mj.product = a.product)
SELECT store, product, round(m1, 6) mi_x1_y, round(m2, 6) mi_x2_y, round(m12, 6) mi_x1x2_y, round(red, 6) redundancy, round(greatest(0, m1 - red), 6) unique_x1, round(greatest(0, m2 - red), 6) unique_x2, round(greatest(0, m12 - greatest(0, m1 - red) - greatest(0, m2 - red) - red), 6) synergy FROM p""")
def l5_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What last week's demand and the stock flag tell of demand, in bits: shared, each one's own, and only together."""
    out = I.parts_told(_told(spark, sf_dir), KEYS, "lag_1", "in_stock")
    return out.select(*KEYS, *(F.round(c, 6).alias(c) for c in out.columns if c not in KEYS))


@query(_BINNED_SQL + """, w AS (SELECT *, min(mi) OVER p lo, max(mi) OVER p hi, sum(mi) OVER p total FROM mi WINDOW p AS (PARTITION BY store, product))
SELECT store, product, feature, round(mi, 6) mi, CAST(row_number() OVER (PARTITION BY store, product ORDER BY round(mi, 9) DESC, feature) AS INTEGER) AS rank, round(CASE WHEN hi = 0 THEN 1.0 ELSE 0.5 + 1.5 * (mi - lo) / (hi - lo + 1e-9) END, 5) weight, CAST(least(120, greatest(10, trunc(100 - 60 * total))) AS INTEGER) k FROM w""")
def l7_feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features ranked by their information about demand, with weights and a number of neighbours."""
    mi = _told(spark, sf_dir).where("feature != 'joint'")
    return I.feature_weights(mi, KEYS).select(*KEYS, "feature", F.round("mi", 6).alias("mi"), "rank", F.round("weight", 5).alias("weight"), "k")


_TARGETS = (0.75, 0.8333, 0.85, 0.925)


@query(_SCORED_SQL + f""", sg AS (SELECT *, lead(tau) OVER w t2, lead(value) OVER w v2 FROM sc WINDOW w AS (PARTITION BY model, store, product, fold_idx, step ORDER BY tau)),
q AS (SELECT model, store, product, fold_idx, step, y, level, value + (v2 - value) * (level - tau) / (t2 - tau) q FROM sg, (SELECT unnest([{', '.join(map(str, _TARGETS))}]::DOUBLE[]) level) WHERE tau <= level AND level < t2),
v AS (SELECT store, product, sum(y) volume FROM (SELECT DISTINCT store, product, fold_idx, step, y FROM sc) GROUP BY ALL), l AS (SELECT q.*, volume, greatest(level * (y - q), (level - 1) * (y - q)) loss, CASE WHEN y >= q THEN y - q ELSE 0.2 * (q - y) END cost FROM q JOIN v USING (store, product))
SELECT model, level, round(avg(loss), 6) pinball, round(avg(cost), 6) cost_weighted, round(sum(loss * volume) / sum(volume), 6) volume_weighted, round(avg(CASE WHEN y <= q THEN 1.0 ELSE 0.0 END), 6) coverage FROM l GROUP BY ALL""")
def i10_service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses at service levels between the forecast ones, by interpolation: plain, at the costs of shortage and holding, and weighted by each series' volume."""
    rows = _scored(spark, sf_dir)
    volume = rows.where("model = 'mean' and tau = 0.5").groupBy(*KEYS).agg(F.sum("y").alias("volume"))
    over = Window.partitionBy(*MODEL).orderBy("tau")
    rows = rows.select(*MODEL, "tau", "value", "y", F.lead("tau").over(over).alias("t2"), F.lead("value").over(over).alias("v2"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, _TARGETS))).alias("level"))
    rows = rows.where("tau <= level and level < t2").withColumn("q", F.expr("value + (v2 - value) * (level - tau) / (t2 - tau)")).join(volume, KEYS)
    loss, cost = scoring.pinball(F.col("level"), F.col("q"), F.col("y")), F.expr("case when y >= q then y - q else 0.2 * (q - y) end")
    c = {"pinball": F.avg(loss), "cost_weighted": F.avg(cost), "volume_weighted": F.sum(loss * F.col("volume")) / F.sum("volume"), "coverage": F.avg((F.col("y") <= F.col("q")).cast("double"))}
    return rows.groupBy("model", "level").agg(*(F.round(v, 6).alias(n) for n, v in c.items()))


_HELD = "fold_idx < 8"


@query(_SCORED_SQL + """, h AS (SELECT * FROM sc WHERE fold_idx < 8), a AS (SELECT model, tau, quantile_cont(value, 0.5) FILTER (value > 0) mf, quantile_cont(y, 0.5) FILTER (y > 0) ma FROM h GROUP BY ALL),
f AS (SELECT model, tau, CASE WHEN mf > 0 THEN ma / mf ELSE 1.0 END scale FROM a)
SELECT model, store, product, fold_idx, step, tau, round(max(greatest(0.0, value * scale)) OVER (PARTITION BY model, store, product, fold_idx, step ORDER BY tau), 5) AS value FROM sc JOIN f USING (model, tau) WHERE fold_idx >= 8""")
def f20_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the last four folds times the ratio of the earlier folds' median outcome to their median forecast, per level."""
    rows = _scored(spark, sf_dir)
    some = lambda c: F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5))
    scale = rows.where(_HELD).groupBy("model", "tau").agg(F.when(some("value") > 0, some("y") / some("value")).otherwise(1.0).alias("scale"))
    moved = rows.where("fold_idx >= 8").join(F.broadcast(scale), ["model", "tau"]).withColumn("moved", F.greatest(F.lit(0.0), F.col("value") * F.col("scale")))  # a row for each model and level
    return moved.select(*MODEL, "tau", F.round(F.max("moved").over(Window.partitionBy(*MODEL).orderBy("tau")), 5).alias("value"))


@query(_SCORED_SQL + """, a AS (SELECT model, tau, y - value r FROM sc WHERE fold_idx < 8), s AS (SELECT *, row_number() OVER (PARTITION BY model, tau ORDER BY r) i, count(*) OVER (PARTITION BY model, tau) n FROM a), p AS (SELECT *, tau * (n - 1) place FROM s),
f AS (SELECT model, tau, sum(CASE WHEN i - 1 = floor(place) THEN r * (1 - (place - floor(place))) WHEN i - 1 = floor(place) + 1 THEN r * (place - floor(place)) ELSE 0 END) move FROM p GROUP BY ALL)
SELECT model, store, product, fold_idx, step, tau, round(max(greatest(0.0, value + move)) OVER (PARTITION BY model, store, product, fold_idx, step ORDER BY tau), 5) AS value FROM sc JOIN f USING (model, tau) WHERE fold_idx >= 8""")
def f20_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the last four folds moved by the earlier folds' residual quantile of their own level."""
    rows = _scored(spark, sf_dir)
    all_levels = F.percentile(F.round(F.col("y") - F.col("value"), 9), F.array(*map(F.lit, LEVELS)))
    moves = rows.where(_HELD).groupBy("model", "tau").agg(all_levels.alias("q"))
    at = F.get("q", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("tau")).cast("int") - 1)
    moves = F.broadcast(moves.select("model", "tau", at.alias("adjustment")))  # a row for each model and level
    out = evaluation.calibrated(rows.where("fold_idx >= 8").drop("y"), moves, ["model"], MODEL)
    return out.select(*MODEL, "tau", F.round("value", 5).alias("value"))


@query(_SCORED_SQL + """, h AS (SELECT * FROM sc WHERE fold_idx < 8), rc AS (SELECT model, tau, round(y - value, 6) res, count(*) c FROM h GROUP BY ALL), rk AS (SELECT *, sum(c) OVER (PARTITION BY model, tau ORDER BY res) cum, sum(c) OVER (PARTITION BY model, tau) n FROM rc),
aj AS (SELECT model, tau, min(res) adjustment FROM rk WHERE cum >= greatest(1, least(n, ceil(round((n + 1) * tau, 9)))) GROUP BY ALL),
c AS (SELECT model, tau, any_value(adjustment) adjustment, avg(CASE WHEN y <= value THEN 1.0 ELSE 0.0 END) b, avg(CASE WHEN round(y - value, 6) <= adjustment THEN 1.0 ELSE 0.0 END) a FROM h JOIN aj USING (model, tau) GROUP BY ALL)
SELECT model, tau, round(b, 6) coverage_before, round(a, 6) coverage_after, round(adjustment, 5) adjustment, abs(tau - a) < abs(tau - b) AS improvement FROM c""")
def f20_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of outcomes at or below each level before and after calibration on the folds it was taken from."""
    rows = _scored(spark, sf_dir).where(_HELD)
    moves = evaluation.conformal_adjustments(rows, ["model"])
    r = F.col("y") - F.col("value")
    c = rows.join(F.broadcast(moves), ["model", "tau"]).groupBy("model", "tau").agg(F.first("adjustment").alias("adjustment"), F.avg((r <= 0).cast("double")).alias("b"), F.avg((F.round(r, 6) <= F.col("adjustment")).cast("double")).alias("a"))
    return c.select("model", "tau", F.round("b", 6).alias("coverage_before"), F.round("a", 6).alias("coverage_after"), F.round("adjustment", 5).alias("adjustment"), (F.abs(F.col("tau") - F.col("a")) < F.abs(F.col("tau") - F.col("b"))).alias("improvement"))


_ACF52_SQL = """, dv AS (SELECT store, product, week_idx, demand - avg(demand) OVER (PARTITION BY store, product) d FROM panel), ss AS (SELECT store, product, sum(d * d) ss, count(*) n FROM dv GROUP BY ALL),
cs AS (SELECT store, product, sum(s * s) cs FROM (SELECT store, product, sum(d) OVER (PARTITION BY store, product ORDER BY week_idx) s FROM dv) GROUP BY ALL),
ac AS (SELECT a.store, a.product, CAST(k AS INTEGER) lag, any_value(n) n, any_value(ss) ss, sum(a.d * b.d) / any_value(ss) acf FROM (SELECT unnest(range(1, 53)) k) JOIN dv a ON true JOIN dv b ON a.store = b.store AND a.product = b.product AND b.week_idx = a.week_idx - k JOIN ss ON ss.store = a.store AND ss.product = a.product WHERE ss > 0 GROUP BY a.store, a.product, k),
al AS (SELECT store, product, any_value(n) n, any_value(ss) ss, list(acf ORDER BY lag) r FROM ac GROUP BY ALL)"""
_PACF_SQL = _ACF52_SQL + """, dl AS (SELECT store, product, n, r, 1 AS k, [r[1]] phi, [r[1]] pacf FROM al
 UNION ALL SELECT store, product, n, r, k + 1, list_concat([phi[j] - nw * phi[k + 1 - j] FOR j IN range(1, k + 1)], [nw]), list_concat(pacf, [nw]) FROM (SELECT *, (r[k + 1] - list_sum([phi[j] * r[k + 1 - j] FOR j IN range(1, k + 1)])) / (1 - list_sum([phi[j] * r[j] FOR j IN range(1, k + 1)])) nw FROM dl WHERE k < len(r)))"""


def _acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, product, n, acf: an array over 52 lags (fewer in shorter series)."""
    rows = statistics.autocorrelations(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand", 52)
    return rows.withColumn("acf", F.array_compact("acf")).where(F.size("acf") > 0)


@query(_PACF_SQL + """, p AS (SELECT store, product, n, unnest(range(1, len(r) + 1)) lag, unnest(r) acf, unnest(pacf) pacf FROM dl WHERE k = len(r))
SELECT store, product, CAST(lag AS INTEGER) lag, round(acf, 6) acf, round(pacf, 5) pacf, round(1.96 / sqrt(n), 6) bound, abs(acf) > 1.96 / sqrt(n) AS significant FROM p""")
def k2_partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelations and partial ones at 52 lags, with the bound beyond which they are significant."""
    rows = _acf(spark, sf_dir).withColumn("pacf", I.partial_autocorrelation(F.col("acf")))
    bound = 1.96 / F.sqrt("n")
    rows = rows.select(*KEYS, "n", F.posexplode(F.arrays_zip("acf", "pacf")).alias("i", "z"))
    return rows.select(*KEYS, (F.col("i") + 1).alias("lag"), F.round("z.acf", 6).alias("acf"), F.round("z.pacf", 5).alias("pacf"), F.round(bound, 6).alias("bound"), (F.abs("z.acf") > bound).alias("significant"))


@query(_PACF_SQL + """, p AS (SELECT n, unnest(range(1, len(r) + 1)) lag, unnest(r) acf, unnest(pacf) pacf FROM dl WHERE k = len(r))
SELECT CAST(lag AS INTEGER) lag, round(quantile_cont(acf, 0.5), 5) acf, round(quantile_cont(pacf, 0.5), 4) pacf, round(avg(CASE WHEN abs(acf) > 1.96 / sqrt(n) THEN 1.0 ELSE 0.0 END), 6) share_significant FROM p GROUP BY ALL""")
def k2_median_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series' median at each lag, and the share of series in which it is significant."""
    rows = _acf(spark, sf_dir).withColumn("pacf", I.partial_autocorrelation(F.col("acf"))).select("n", F.posexplode(F.arrays_zip("acf", "pacf")).alias("i", "z"))
    half = F.lit(0.5)
    return rows.groupBy((F.col("i") + 1).alias("lag")).agg(F.round(F.percentile("z.acf", half), 5).alias("acf"), F.round(F.percentile("z.pacf", half), 4).alias("pacf"), F.round(F.avg((F.abs("z.acf") > 1.96 / F.sqrt("n")).cast("double")), 6).alias("share_significant"))


@query(_ACF52_SQL + """, a0 AS (SELECT al.*, cs, CAST(floor(power(n, 2.0 / 9)) AS INTEGER) m FROM al JOIN cs USING (store, product)), a1 AS (SELECT *, 2 * list_sum([i * r[i] FOR i IN range(1, m + 1)]) / (1 + 2 * list_sum(r[1 : m])) q FROM a0),
a2 AS (SELECT *, CAST(least(floor(1.1447 * power(q * q, 1.0 / 3) * power(n, 1.0 / 3)), n - 1, len(r)) AS INTEGER) lags FROM a1), a3 AS (SELECT *, cs / (n * n) / (ss / n * (1 + 2 * coalesce(list_sum([r[i] * (1 - i / (lags + 1)) FOR i IN range(1, lags + 1)]), 0))) stat FROM a2)
SELECT store, product, round(stat, 5) stat, lags, round(CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 + (stat - 0.347) * (-0.05 / 0.116) WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) * (-0.025 / 0.111) WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) * (-0.015 / 0.165) ELSE 0.01 END, 4) p_value, stat <= 0.463 AS stationary FROM a3""")
def k6_stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level stationarity with as many lags as the series asks for, its p and whether that is above 0.05."""
    rows = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", (F.col("demand") - F.avg("demand").over(Window.partitionBy(*KEYS))).alias("d"))
    sums = rows.withColumn("s", F.sum("d").over(X.ordered())).groupBy(*KEYS).agg(F.sum(F.col("d") * F.col("d")).alias("ss"), F.sum(F.col("s") * F.col("s")).alias("cs"))
    return I.level_stationarity(_acf(spark, sf_dir), sums, KEYS).select(*KEYS, F.round("stat", 5).alias("stat"), "lags", F.round("p_value", 4).alias("p_value"), "stationary")


@query()
def k5_changing_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit of squared deviations on up to twelve of their own lags."""
    return I.changing_variance(demand_panel(spark, sf_dir), KEYS)
