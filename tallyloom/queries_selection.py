"""Registered queries: closed-loop replay, parameter grids, detailed scores, selection and comparisons, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .operators import inventory, scoring, splits
from .plans.bindings import KEYS, demand_panel, given_orders, state
from .queries_models import _FOLDS_SQL, _LEDGER_SQL, _PER_SQL, _PMF_SQL, _SCORED_SQL, _STOCK_SQL, FOLD, MODEL, _ledger, _pmf, _scored, _stock
from .registry import query


def _per(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_forecast(_scored(spark, sf_dir), MODEL)


_REPLAY_SQL = """, tg AS (SELECT store, product, z, avg(demand) * 3 + z * stddev_samp(demand) * sqrt(3.0) AS target FROM panel, (SELECT unnest([0.5, 1.0, 1.5]::DOUBLE[]) z) WHERE week_idx < 300 GROUP BY store, product, z),
rp AS (SELECT store, product, z, target, 299 AS w, on_hand s, intransit_1 a, intransit_2 b, 0.0::DOUBLE h, 0.0::DOUBLE c, 0.0::DOUBLE n FROM state JOIN tg USING (store, product)
 UNION ALL SELECT r.store, r.product, z, target, w + 1, greatest(s + a - demand, 0), b, greatest(round_even(target - greatest(s + a - demand, 0) - b, 0), 0), h + greatest(s + a - demand, 0) * 0.2, c + greatest(demand - s - a, 0), n + greatest(round_even(target - greatest(s + a - demand, 0) - b, 0), 0)
 FROM rp r JOIN panel p ON p.store = r.store AND p.product = r.product AND p.week_idx = r.w + 1)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    s = panel.where("week_idx < 300").groupBy(*KEYS).agg(F.avg("demand").alias("mu"), F.stddev_samp("demand").alias("sd"))
    targets = s.select("*", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5)))).alias("z")).select(*KEYS, "z", (F.col("mu") * 3 + F.col("z") * F.col("sd") * F.sqrt(F.lit(3.0))).alias("target"))
    return inventory.replay(panel.where("week_idx >= 300"), state(panel), targets)


@query(_REPLAY_SQL + " SELECT store, product, z, round(h, 4) holding_cost, round(c, 4) shortage_cost, n AS ordered FROM rp WHERE w = (SELECT max(week_idx) FROM panel)")
def h3_closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).select(*KEYS, "z", F.round("holding_cost", 4).alias("holding_cost"), F.round("shortage_cost", 4).alias("shortage_cost"), "ordered")


@query(_REPLAY_SQL + ", g AS (SELECT z, sum(h + c) t FROM rp WHERE w = (SELECT max(week_idx) FROM panel) GROUP BY ALL) SELECT z, round(t, 3) total_cost, t = (SELECT min(t) FROM g) AS best FROM g")
def h5_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total cost of each safety factor and which is best."""
    g = _replayed(spark, sf_dir).groupBy("z").agg(F.sum(F.col("holding_cost") + F.col("shortage_cost")).alias("t"))
    best = g.agg(F.min_by("z", "t").alias("best_z"))
    return g.crossJoin(F.broadcast(best)).select("z", F.round("t", 3).alias("total_cost"), (F.col("z") == F.col("best_z")).alias("best"))  # one row


_Q_PMF_SQL = _SCORED_SQL + """, pts AS (SELECT store, product, step, tau, max(greatest(value, 0)) OVER (PARTITION BY store, product, step ORDER BY tau) v FROM sc WHERE model = 'mean' AND fold_idx = 0),
tp AS (SELECT store, product, step, max(v) AS mx FROM pts GROUP BY ALL), al AS (SELECT * FROM pts UNION ALL SELECT store, product, step, 0.0, 0.0 FROM tp UNION ALL SELECT store, product, step, 1.0, mx FROM tp),
sg AS (SELECT *, lead(tau) OVER w t2, lead(v) OVER w v2 FROM al WINDOW w AS (PARTITION BY store, product, step ORDER BY tau, v)), su AS (SELECT store, product, step, unnest(range(0, CAST(ceil(mx) AS BIGINT) + 1)) AS x FROM tp),
cd AS (SELECT su.store, su.product, su.step, su.x, coalesce(max(CASE WHEN v2 > v AND su.x >= v AND su.x < v2 THEN tau + (t2 - tau) * (su.x - v) / (v2 - v) END), 1.0) cdf FROM su JOIN sg ON su.store = sg.store AND su.product = sg.product AND su.step = sg.step GROUP BY ALL),
df AS (SELECT *, cdf - coalesce(lag(cdf) OVER (PARTITION BY store, product, step ORDER BY x), 0) p FROM cd)"""


@query(_Q_PMF_SQL + " SELECT store, product, step, CAST(x AS INTEGER) AS x, round(greatest(p, 0) / sum(greatest(p, 0)) OVER (PARTITION BY store, product, step), 6) p FROM df")
def e6_quantiles_to_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("model = 'mean' and fold_idx = 0")
    return inventory.quantiles_to_pmf(rows, [*KEYS, "step"]).select(*KEYS, "step", "x", F.round("p", 6).alias("p"))


@query(_SCORED_SQL + """, dr AS (SELECT unnest(range(20)) i), sg AS (SELECT *, lead(tau) OVER w t2, lead(value) OVER w v2, max(value) OVER (PARTITION BY store, product) hi FROM sc WHERE model = 'mean' AND fold_idx = 0 AND step = 1 WINDOW w AS (PARTITION BY store, product ORDER BY tau))
SELECT store, product, CAST(i AS INTEGER) draw, round(max(CASE WHEN (i + 0.5) / 20 >= tau AND (i + 0.5) / 20 < t2 THEN value + (v2 - value) * ((i + 0.5) / 20 - tau) / (t2 - tau) END), 6) AS value FROM sg, dr GROUP BY ALL""")
def e5_stratified_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse distribution functions at evenly spread levels."""
    rows = _scored(spark, sf_dir).where("model = 'mean' and fold_idx = 0 and step = 1")
    over = Window.partitionBy(*KEYS).orderBy("tau")
    seg = rows.select(*KEYS, "tau", "value", F.lead("tau").over(over).alias("t2"), F.lead("value").over(over).alias("v2"))
    u = (F.col("draw") + 0.5) / 20
    drawn = seg.select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("draw"))
    value = F.when((u >= F.col("tau")) & (u < F.col("t2")), F.col("value") + (F.col("v2") - F.col("value")) * (u - F.col("tau")) / (F.col("t2") - F.col("tau")))
    return drawn.groupBy(*KEYS, "draw").agg(F.round(F.max(value), 6).alias("value"))


@query(_STOCK_SQL + ", k AS (SELECT store, product, 0.2 * greatest(20 - x, 0) + greatest(x - 20, 0) AS c, p FROM net), q AS (SELECT *, sum(p) OVER (PARTITION BY store, product ORDER BY round(c, 9)) cp FROM k) SELECT store, product, round(sum(c * p), 6) expected_cost, round(min(c) FILTER (cp >= 0.05 - 1e-9), 6) cost_5th, round(min(c) FILTER (cp >= 0.95 - 1e-9), 6) cost_95th, round(sqrt(greatest(sum(c * c * p) - sum(c * p) ** 2, 0)), 5) cost_std FROM q GROUP BY ALL")
def g14_expected_cost_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected cost of ordering 20, its 5 and 95 % points and deviation."""
    pmf = _pmf(spark, sf_dir)
    net = inventory.convolve(pmf, inventory.leftover(pmf, _stock(demand_panel(spark, sf_dir)), KEYS), KEYS, F.col("xa") - F.col("xb"))
    k = net.select(*KEYS, "p", (0.2 * F.greatest(20 - F.col("x"), F.lit(0)) + F.greatest(F.col("x") - 20, F.lit(0))).alias("c"))
    k = k.withColumn("cp", F.sum("p").over(Window.partitionBy(*KEYS).orderBy(F.round("c", 9))))
    c, p = F.col("c"), F.col("p")
    point = lambda t: F.round(F.min(F.when(F.col("cp") >= t - 1e-9, c)), 6)
    var = F.greatest(F.sum(c * c * p) - F.sum(c * p) ** 2, F.lit(0.0))
    return k.groupBy(*KEYS).agg(F.round(F.sum(c * p), 6).alias("expected_cost"), point(0.05).alias("cost_5th"), point(0.95).alias("cost_95th"), F.round(F.sqrt(var), 5).alias("cost_std"))


@query(_PMF_SQL + ", c AS (SELECT *, sum(p) OVER (PARTITION BY store, product ORDER BY x) cdf FROM pmf), i AS (SELECT store, product, quantile_cont(demand, 0.5) med, quantile_cont(demand, 0.75) - quantile_cont(demand, 0.25) iqr FROM panel WHERE week_idx >= 253 GROUP BY ALL) SELECT c.store, c.product, min(x) FILTER (cdf >= 0.833 - 1e-9) sip_order, round_even(any_value(med) + 0.967 * any_value(iqr) / 1.35, 0) point_order FROM c JOIN i ON c.store = i.store AND c.product = i.product GROUP BY c.store, c.product")
def g12_single_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).where("week_idx >= 253")
    q = lambda p: F.percentile("demand", F.lit(p))
    point = rows.groupBy(*KEYS).agg(F.bround(q(0.5) + 0.967 * (q(0.75) - q(0.25)) / 1.35).alias("point_order"))
    return inventory.fractile(_pmf(spark, sf_dir), KEYS, 0.833).withColumnRenamed("x", "sip_order").join(point, KEYS)


@query("SELECT store, product, greatest(0.0, round_even(sum(demand) - any_value(on_hand + intransit_1 + intransit_2), 0)) order_qty FROM panel JOIN state USING (store, product) WHERE week_idx >= 353 GROUP BY ALL")
def g11_order_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weeks' demand less the position."""
    panel = demand_panel(spark, sf_dir)
    four = panel.where("week_idx >= 353").groupBy(*KEYS).agg(F.sum("demand").alias("d")).join(state(panel), KEYS)
    return four.select(*KEYS, F.greatest(F.lit(0.0), F.bround(F.col("d") - F.col("on_hand") - F.col("intransit_1") - F.col("intransit_2"))).alias("order_qty"))


@query(_SCORED_SQL + ", a AS (SELECT *, row_number() OVER (PARTITION BY model, store, product, fold_idx, step ORDER BY round(abs(tau - 0.833), 9), tau) r FROM sc) SELECT model, round(avg(greatest(tau * (y - value), (tau - 1) * (y - value))), 6) pinball_cf, round(avg(CASE WHEN y >= value THEN 1.0 ELSE 0.0 END), 6) hit_cf, round(avg(CASE WHEN y > value THEN y - value ELSE 0.2 * (value - y) END), 6) asymmetric_loss FROM a WHERE r = 1 GROUP BY ALL")
def i7_newsvendor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the level nearest to the critical fractile."""
    rank = F.row_number().over(Window.partitionBy(*MODEL).orderBy(F.round(F.abs(F.col("tau") - 0.833), 9), "tau"))
    a = _scored(spark, sf_dir).withColumn("r", rank).where("r = 1")
    y, v = F.col("y"), F.col("value")
    return a.groupBy("model").agg(F.round(F.avg(scoring.pinball(F.col("tau"), v, y)), 6).alias("pinball_cf"), F.round(F.avg((y >= v).cast("double")), 6).alias("hit_cf"), F.round(F.avg(F.when(y > v, y - v).otherwise(0.2 * (v - y))), 6).alias("asymmetric_loss"))


@query(_SCORED_SQL + " SELECT model, tau, round(avg(greatest(tau * (y - value), (tau - 1) * (y - value))), 6) pinball, round(avg(CASE WHEN y <= value THEN 1.0 ELSE 0.0 END), 6) coverage FROM sc GROUP BY ALL")
def i10_i19_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and share of outcomes at or below, per model and level."""
    loss = scoring.pinball(F.col("tau"), F.col("value"), F.col("y"))
    return _scored(spark, sf_dir).groupBy("model", "tau").agg(F.round(F.avg(loss), 6).alias("pinball"), F.round(F.avg((F.col("y") <= F.col("value")).cast("double")), 6).alias("coverage"))


@query(_PER_SQL + ", s AS (SELECT model, store, product, avg(error) bias, avg(abs(error)) mae FROM per GROUP BY ALL) SELECT model, store, product, round(bias, 6) bias, round(mae, 6) mae, CAST(row_number() OVER (PARTITION BY model ORDER BY round(mae, 6) DESC, store, product) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mae, 6) DESC, store, product) <= 50")
def i11_worst_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty series of largest error per model (a top-k report)."""
    s = _per(spark, sf_dir).groupBy("model", *KEYS).agg(F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.round("mae", 6)), *KEYS))
    return s.select("model", *KEYS, F.round("bias", 6).alias("bias"), F.round("mae", 6).alias("mae"), rank.alias("rank")).where("rank <= 50")


@query(_PER_SQL + " SELECT model, store, product, round(avg(CASE WHEN error > 0 THEN 1.0 ELSE 0.0 END), 6) under_share, round(coalesce(avg(error) FILTER (error > 0), 0), 6) mean_under, avg(CASE WHEN error > 0 THEN 1.0 ELSE 0.0 END) > 0.6 AS guarded FROM per GROUP BY ALL")
def i15_underforecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("error") > 0).cast("double"))
    return _per(spark, sf_dir).groupBy("model", *KEYS).agg(F.round(share, 6).alias("under_share"), F.round(F.coalesce(F.avg(F.when(F.col("error") > 0, F.col("error"))), F.lit(0.0)), 6).alias("mean_under"), (share > 0.6).alias("guarded"))


@query(_PER_SQL + ", c AS (SELECT store, product, CASE WHEN avg(demand) < 43 THEN 'low' ELSE 'high' END cohort FROM panel GROUP BY ALL) SELECT model, cohort, step, count(*) n, round(avg(pinball), 6) pinball, round(avg(covered_80), 6) coverage_80 FROM per JOIN c USING (store, product) GROUP BY ALL")
def i16_cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.when(F.avg("demand") < 43, "low").otherwise("high").alias("cohort"))
    return _per(spark, sf_dir).join(c, KEYS).groupBy("model", "cohort", "step").agg(F.count("*").alias("n"), F.round(F.avg("pinball"), 6).alias("pinball"), F.round(F.avg("covered_80"), 6).alias("coverage_80"))


@query(_PER_SQL + ", w AS (SELECT store, product, avg(width_80) w FROM per WHERE model = 'seasonal' GROUP BY ALL), f AS (SELECT store, product, avg(demand) mean, stddev_pop(demand) sd FROM panel GROUP BY ALL) SELECT feature, round(corr(w, v), 6) correlation FROM (SELECT w, unnest(['mean', 'sd']) feature, unnest([mean, sd]) v FROM w JOIN f USING (store, product)) GROUP BY ALL")
def i18_width_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _per(spark, sf_dir).where("model = 'seasonal'").groupBy(*KEYS).agg(F.avg("width_80").alias("w"))
    f = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg("demand").alias("mean"), F.stddev_pop("demand").alias("sd"))
    return w.join(f, KEYS).unpivot("w", ["mean", "sd"], "feature", "v").groupBy("feature").agg(F.round(F.corr("w", "v"), 6).alias("correlation"))


_BEST_SQL = _PER_SQL + ", m AS (SELECT model, store, product, avg(pinball) c FROM per GROUP BY ALL), pk AS (SELECT store, product, arg_min(model, (round(c, 9), model)) AS pick, min(c) c FROM m GROUP BY ALL)"


def _picks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _per(spark, sf_dir).groupBy("model", *KEYS).agg(F.avg("pinball").alias("c"))
    return m, m.groupBy(*KEYS).agg(F.min_by("model", F.struct(F.round("c", 9), "model")).alias("pick"), F.min("c").alias("c"))


@query(_BEST_SQL + " SELECT model, round(sum(c), 5) total, count(*) n FROM m GROUP BY ALL UNION ALL SELECT 'selector', round(sum(c), 5), count(*) FROM pk")
def j5_j7_selector_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per model and of picking the best model for each series."""
    m, picks = _picks(spark, sf_dir)
    total = [F.round(F.sum("c"), 5).alias("total"), F.count("*").alias("n")]
    return m.groupBy("model").agg(*total).unionByName(picks.agg(*total).select(F.lit("selector").alias("model"), "total", "n"))


@query(_BEST_SQL + ", b AS (SELECT store, pick AS model, count(*) wins FROM pk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY wins DESC, model) r FROM b) SELECT store, model AS rule, wins FROM r WHERE r = 1")
def j9_cohort_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cohort (here the store) the model that wins most series."""
    b = _picks(spark, sf_dir)[1].groupBy("store", F.col("pick").alias("rule")).agg(F.count("*").alias("wins"))
    rank = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("wins"), "rule"))
    return b.withColumn("r", rank).where("r = 1").drop("r")


@query(_BEST_SQL + ", v AS (SELECT store, product, max(c) FILTER (model = 'mean') a, max(c) FILTER (model = 'seasonal') b FROM m GROUP BY ALL) SELECT CAST(w AS INTEGER) weight_pct, round(sum(a * w / 100.0 + b * (100 - w) / 100.0), 4) total FROM v, (SELECT unnest(range(0, 101, 10)) w) GROUP BY ALL")
def j12_pool_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _picks(spark, sf_dir)[0].groupBy(*KEYS).pivot("model", ["mean", "seasonal"]).agg(F.max("c")).select("*", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(10))).alias("weight_pct"))
    w = F.col("weight_pct") / 100.0
    return v.groupBy("weight_pct").agg(F.round(F.sum(F.col("mean") * w + F.col("seasonal") * (1 - w)), 4).alias("total"))


@query(_BEST_SQL + " SELECT p.store, p.product, CAST(wk AS INTEGER) AS week, CASE WHEN (p.product + wk) % 4 = 0 THEN 'weekly' WHEN p.product % 3 <> 0 THEN pick ELSE 'mean' END AS model FROM pk p, (SELECT unnest(range(1, 3)) wk)")
def j14_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly pick, else the series' static pick, else the default."""
    picks = _picks(spark, sf_dir)[1]
    wanted = picks.select(*KEYS, F.explode(F.array(F.lit(1), F.lit(2))).alias("week"))
    weekly = wanted.where("(product + week) % 4 = 0").withColumn("w", F.lit("weekly"))
    static = picks.where("product % 3 <> 0").select(*KEYS, "pick")
    return wanted.join(weekly, [*KEYS, "week"], "left").join(static, KEYS, "left").select(*KEYS, "week", F.coalesce("w", "pick", F.lit("mean")).alias("model"))


@query(_PER_SQL + " SELECT model, round(sum(CASE WHEN error > 0 THEN error ELSE 0 END) / sum(CASE WHEN error < 0 THEN -error ELSE 0 END), 6) cost_ratio, round(least(3.0, greatest(0.5, quantile_cont((y + 1) / (y - error + 1), 0.5))), 6) multiplier FROM per GROUP BY ALL")
def j19_model_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under- to over-forecast, and the median ratio of outcome to median forecast held between .5 and 3."""
    e, y = F.col("error"), F.col("y")
    ratio = F.percentile((y + 1) / (y - e + 1), F.lit(0.5))
    return _per(spark, sf_dir).groupBy("model").agg(F.round(F.sum(F.greatest(e, F.lit(0.0))) / F.sum(F.greatest(-e, F.lit(0.0))), 6).alias("cost_ratio"), F.round(F.least(F.lit(3.0), F.greatest(F.lit(0.5), ratio)), 6).alias("multiplier"))


@query(_BEST_SQL + " SELECT cur.store, cur.product, ch.model challenger, round(1 - ch.c / cur.c, 6) gain, 1 - ch.c / cur.c >= 0.1 AS switches FROM m cur JOIN m ch ON cur.store = ch.store AND cur.product = ch.product AND cur.model = 'seasonal' AND ch.model <> cur.model")
def j22_challengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _picks(spark, sf_dir)[0]
    cur = m.where("model = 'seasonal'").select(*KEYS, F.col("c").alias("cur"))
    gain = 1 - F.col("c") / F.col("cur")
    return m.where("model <> 'seasonal'").join(cur, KEYS).select(*KEYS, F.col("model").alias("challenger"), F.round(gain, 6).alias("gain"), (gain >= 0.1).alias("switches"))


@query(_LEDGER_SQL + ", z AS (SELECT store, product, round(sum(holding_cost + shortage_cost), 6) cost FROM ledger GROUP BY ALL) SELECT coalesce(a.store, b.store) store, coalesce(a.product, b.product) product, a.cost - b.cost AS delta FROM (SELECT * FROM z WHERE product % 4 <> 0) a FULL JOIN (SELECT store, product, cost + 10 AS cost FROM z WHERE product % 5 <> 0) b ON a.store = b.store AND a.product = b.product")
def j24_j28_cost_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of two runs series by series, series of either kept."""
    z = _ledger(spark, sf_dir).groupBy(*KEYS).agg(F.round(F.sum(F.col("holding_cost") + F.col("shortage_cost")), 6).alias("cost"))
    a, b = z.where("product % 4 <> 0"), z.where("product % 5 <> 0").select(*KEYS, (F.col("cost") + 10).alias("other"))
    return a.join(b, KEYS, "full").select(*KEYS, (F.col("cost") - F.col("other")).alias("delta"))


@query(", b AS (SELECT store, product, order_qty s, round_even(order_qty * 1.1, 0) r FROM orders_given WHERE week_idx = 300) SELECT store, CAST(count_if(s = r) AS BIGINT) n_exact, CAST(count_if(abs(s - r) <= 1) AS BIGINT) within_1, CAST(count_if(abs(s - r) <= 5) AS BIGINT) within_5, round(avg(s - r), 6) mean_gap FROM b GROUP BY ALL")
def j26_order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = given_orders(demand_panel(spark, sf_dir)).where("week_idx = 300").select("store", F.col("order_qty").alias("s"), F.bround(F.col("order_qty") * 1.1).alias("r"))
    gap = F.abs(F.col("s") - F.col("r"))
    return b.groupBy("store").agg(F.count_if(gap == 0).alias("n_exact"), F.count_if(gap <= 1).alias("within_1"), F.count_if(gap <= 5).alias("within_5"), F.round(F.avg(F.col("s") - F.col("r")), 6).alias("mean_gap"))


@query("SELECT count(*) n, round(avg(demand), 6) mean, round(stddev_samp(demand), 6) sd, min(demand) low, quantile_cont(demand, 0.25) q25, quantile_cont(demand, 0.5) q50, quantile_cont(demand, 0.75) q75, max(demand) high FROM panel WHERE store = 0 AND product = 1")
def j30_describe_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile("demand", F.lit(p))
    one = demand_panel(spark, sf_dir).where("store = 0 and product = 1")
    return one.agg(F.count("*").alias("n"), F.round(F.avg("demand"), 6).alias("mean"), F.round(F.stddev_samp("demand"), 6).alias("sd"), F.min("demand").alias("low"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("demand").alias("high"))


@query(_PER_SQL + " SELECT model, round(avg(error), 6) mean, round(stddev_samp(error), 6) sd, round(sqrt(avg(error * error)), 6) rmse, round(avg(abs(error)) / (SELECT min(a) FROM (SELECT avg(abs(error)) a FROM per GROUP BY model)), 6) mae_ratio FROM per GROUP BY ALL")
def k13_k14_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals per model, and the mean absolute one against the best model's."""
    e = F.col("error")
    r = _per(spark, sf_dir).groupBy("model").agg(F.round(F.avg(e), 6).alias("mean"), F.round(F.stddev_samp(e), 6).alias("sd"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return r.crossJoin(F.broadcast(r.agg(F.min("mae").alias("best")))).select("model", "mean", "sd", "rmse", F.round(F.col("mae") / F.col("best"), 6).alias("mae_ratio"))  # one row


@query(_LEDGER_SQL + " SELECT store, round(avg(CASE WHEN demand <= on_hand_start + arriving THEN 1.0 ELSE 0.0 END), 6) coverage, round(avg(CASE WHEN demand <= on_hand_start + arriving THEN 1.0 ELSE 0.0 END) - 0.833, 6) gap FROM ledger GROUP BY ALL")
def l16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.avg((F.col("demand") <= F.col("on_hand_start") + F.col("arriving")).cast("double"))
    return _ledger(spark, sf_dir).groupBy("store").agg(F.round(c, 6).alias("coverage"), F.round(c - 0.833, 6).alias("gap"))


@query(_PER_SQL + ", s AS (SELECT model, avg(pinball) pinball, avg(crps) crps, avg(abs(error)) mae FROM per GROUP BY ALL) SELECT metric, model, CAST(rank() OVER (PARTITION BY metric ORDER BY round(v, 9)) AS INTEGER) AS rank FROM (SELECT model, unnest(['pinball', 'crps', 'mae']) metric, unnest([pinball, crps, mae]) v FROM s)")
def l17_metric_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _per(spark, sf_dir).groupBy("model").agg(F.avg("pinball").alias("pinball"), F.avg("crps").alias("crps"), F.avg(F.abs("error")).alias("mae"))
    return s.unpivot("model", ["pinball", "crps", "mae"], "metric", "v").select("metric", "model", F.rank().over(Window.partitionBy("metric").orderBy(F.round("v", 9))).alias("rank"))


@query(_FOLDS_SQL + " SELECT fold_idx, CASE WHEN rn <= cut THEN 'train' ELSE 'test' END AS role, count(*) n, min(week_idx) first_week, max(week_idx) last_week FROM folds GROUP BY ALL")
def c5_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and reach of cross-validation folds."""
    rows = splits.rolling_origin(demand_panel(spark, sf_dir))
    return rows.groupBy("fold_idx", "role").agg(F.count("*").alias("n"), F.min("week_idx").alias("first_week"), F.max("week_idx").alias("last_week"))


@query(", s AS (SELECT store, product, avg(demand) FILTER (in_stock) m, stddev_pop(demand) FILTER (in_stock) sd FROM panel GROUP BY ALL) SELECT p.store, p.product, week_idx, round(CASE WHEN in_stock THEN demand ELSE least(demand, greatest(50.0, least(500.0, m + 3 * sd))) END, 6) demand FROM panel p JOIN s USING (store, product)")
def b22_winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-out weeks held at three deviations above the in-stock mean, that bound within 50 to 500."""
    own = Window.partitionBy(*KEYS)
    y = X.effective()
    bound = F.greatest(F.lit(50.0), F.least(F.lit(500.0), F.avg(y).over(own) + 3 * F.stddev_pop(y).over(own)))
    return demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.round(F.when(F.col("in_stock"), F.col("demand")).otherwise(F.least(F.col("demand"), bound)), 6).alias("demand"))
