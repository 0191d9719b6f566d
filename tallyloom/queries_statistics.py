"""Registered queries: descriptive statistics, information, comparisons and leaderboards, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features as X
from .operators import inventory, statistics
from .plans.bindings import KEYS, demand_panel, read, state
from .queries_models import _LEDGER_SQL, _PMF_SQL, _STOCK_SQL, _ledger, _pmf, _stock
from .registry import query


@query(""", r AS (SELECT *, quantile_cont(demand, 0.5) OVER (PARTITION BY store, product) md, avg(demand) OVER (PARTITION BY store, product) mm FROM panel)
SELECT store, product, round(avg(demand), 6) mean, round(stddev_pop(demand), 6) sd, round(stddev_pop(demand) / avg(demand), 6) cv, quantile_cont(demand, 0.25) q25, quantile_cont(demand, 0.5) median, quantile_cont(demand, 0.75) q75,
 quantile_cont(demand, 0.75) - quantile_cont(demand, 0.25) iqr, round((quantile_cont(demand, 0.75) - quantile_cont(demand, 0.25)) / nullif(quantile_cont(demand, 0.75) + quantile_cont(demand, 0.25), 0), 6) qcd, quantile_cont(abs(demand - md), 0.5) mad,
 max(demand) - min(demand) AS range, round(avg((demand - mm) ** 3) / power(avg((demand - mm) ** 2), 1.5), 6) skew, round(kurtosis_pop(demand), 6) kurtosis, round(avg(CASE WHEN demand = 0 THEN 1.0 ELSE 0.0 END), 6) zero_share FROM r GROUP BY ALL""")
def k1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.summary(demand_panel(spark, sf_dir), KEYS, "demand")
    return rows.select(*KEYS, *(F.round(c, 6).alias(c) for c in rows.columns if c not in KEYS))


_ACF_SQL = """, dv AS (SELECT store, product, week_idx, demand - avg(demand) OVER (PARTITION BY store, product) d FROM panel), ss AS (SELECT store, product, sum(d * d) ss, count(*) n FROM dv GROUP BY ALL),
acf AS (SELECT a.store, a.product, CAST(k AS INTEGER) lag, any_value(n) n, sum(a.d * b.d) / any_value(ss) acf FROM (SELECT unnest(range(1, 13)) k) JOIN dv a ON true JOIN dv b ON a.store = b.store AND a.product = b.product AND b.week_idx = a.week_idx - k JOIN ss ON ss.store = a.store AND ss.product = a.product GROUP BY a.store, a.product, k)"""


@query(_ACF_SQL + " SELECT store, product, lag, n, round(acf, 6) acf FROM acf")
def k2_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.autocorrelation(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand").withColumn("acf", F.round("acf", 6))


@query(_ACF_SQL + " SELECT store, product, round(sum(n * (n + 2) * acf * acf / (n - lag)), 4) q, sum(n * (n + 2) * acf * acf / (n - lag)) > 21.026 AS dependent FROM acf GROUP BY ALL")
def k3_ljung_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic over 12 lags and whether it passes the 5 % value of chi-square with 12 degrees of freedom."""
    acf = statistics.autocorrelation(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand")
    q = statistics.ljung_box(acf, KEYS, 12)
    return q.select(*KEYS, F.round("q", 4).alias("q"), (F.col("q") > 21.026).alias("dependent"))


@query(""", e AS (SELECT store, product, CAST(week_idx AS DOUBLE) t, power(demand - avg(demand) OVER (PARTITION BY store, product), 2) e2 FROM panel) SELECT store, product, round(count(*) * power(corr(t, e2), 2), 4) lm FROM e GROUP BY ALL""")
def k4_breusch_pagan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n times the squared correlation of squared residuals with time."""
    rows = demand_panel(spark, sf_dir).select(*KEYS, F.col("week_idx").cast("double").alias("t"), F.pow(F.col("demand") - F.avg("demand").over(Window.partitionBy(*KEYS)), 2).alias("e2"))
    return rows.groupBy(*KEYS).agg(F.round(F.count("*") * F.pow(F.corr("t", "e2"), 2), 4).alias("lm"))


@query(""", e AS (SELECT store, product, week_idx, power(demand - avg(demand) OVER (PARTITION BY store, product), 2) e2 FROM panel), l AS (SELECT *, lag(e2) OVER (PARTITION BY store, product ORDER BY week_idx) l FROM e) SELECT store, product, round(count(l) * power(corr(e2, l), 2), 4) lm FROM l WHERE l IS NOT NULL GROUP BY ALL""")
def k5_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", F.pow(F.col("demand") - F.avg("demand").over(Window.partitionBy(*KEYS)), 2).alias("e2"))
    rows = rows.withColumn("l", F.lag("e2").over(X.ordered())).where("l is not null")
    return rows.groupBy(*KEYS).agg(F.round(F.count("*") * F.pow(F.corr("e2", "l"), 2), 4).alias("lm"))


@query(""", l AS (SELECT *, demand - lag(demand) OVER w dy, lag(demand) OVER w y1 FROM panel WINDOW w AS (PARTITION BY store, product ORDER BY week_idx)), s AS (SELECT store, product, count(*) n, regr_slope(dy, y1) b, regr_r2(dy, y1) r2, var_pop(dy) vy, var_pop(y1) vx FROM l WHERE y1 IS NOT NULL GROUP BY ALL)
SELECT store, product, round(b / sqrt(vy * (1 - r2) / (vx * (n - 2))), 4) t FROM s""")
def k7_dickey_fuller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t of the lagged level in a regression of differences on it."""
    rows = demand_panel(spark, sf_dir).select(*KEYS, (F.col("demand") - F.lag("demand").over(X.ordered())).alias("dy"), F.lag("demand").over(X.ordered()).alias("y1")).where("y1 is not null")
    s = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("dy", "y1").alias("b"), F.regr_r2("dy", "y1").alias("r2"), F.var_pop("dy").alias("vy"), F.var_pop("y1").alias("vx"))
    return s.select(*KEYS, F.round(F.col("b") / F.sqrt(F.col("vy") * (1 - F.col("r2")) / (F.col("vx") * (F.col("n") - 2))), 4).alias("t"))


@query(", b AS (SELECT store, product, week_idx // 13 b, avg(demand) m, var_samp(demand) v FROM panel GROUP BY ALL) SELECT store, product, round(regr_slope(ln(v), ln(m)), 5) slope, round(regr_r2(ln(v), ln(m)), 5) r2 FROM b WHERE m > 0 AND v > 0 GROUP BY ALL")
def k8_power_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.power_law(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand")
    return rows.select(*KEYS, F.round("slope", 5).alias("slope"), F.round("r2", 5).alias("r2"))


@query(""", d AS (SELECT store, product, week_idx, demand - avg(demand) OVER w d, stddev_pop(demand) OVER w sd, count(*) OVER w n FROM panel WINDOW w AS (PARTITION BY store, product)), c AS (SELECT store, product, abs(sum(d) OVER (PARTITION BY store, product ORDER BY week_idx)) / (sd * sqrt(n)) s FROM d)
SELECT store, product, round(max(s), 6) stat, max(s) > 1.358 AS breaks FROM c GROUP BY ALL""")
def k10_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cusum(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand").withColumn("stat", F.round("stat", 6))


@query(""", d AS (SELECT store, product, demand - avg(demand) OVER w d, stddev_pop(demand) OVER w sd FROM panel WINDOW w AS (PARTITION BY store, product)) SELECT store, product, round(avg(power(d / sd, 3)), 5) skew, round(avg(power(d / sd, 4)) - 3, 5) kurtosis, round(count(*) / 6.0 * (power(avg(power(d / sd, 3)), 2) + power(avg(power(d / sd, 4)) - 3, 2) / 4), 4) jarque_bera,
 round(avg(CASE WHEN abs(d) > 2 * sd THEN 1.0 ELSE 0.0 END), 6) beyond_2, round(avg(CASE WHEN abs(d) > 3 * sd THEN 1.0 ELSE 0.0 END), 6) beyond_3 FROM d GROUP BY ALL""")
def k12_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy(*KEYS)
    rows = demand_panel(spark, sf_dir).select(*KEYS, ((F.col("demand") - F.avg("demand").over(own)) / F.stddev_pop("demand").over(own)).alias("z"))
    jb = F.count("*") / 6.0 * (F.avg(F.pow("z", F.lit(3))) ** 2 + (F.avg(F.pow("z", F.lit(4))) - 3) ** 2 / 4)
    return rows.groupBy(*KEYS).agg(F.round(F.avg(F.pow("z", F.lit(3))), 5).alias("skew"), F.round(F.avg(F.pow("z", F.lit(4))) - 3, 5).alias("kurtosis"), F.round(jb, 4).alias("jarque_bera"), *(F.round(F.avg((F.abs("z") > k).cast("double")), 6).alias(f"beyond_{k}") for k in (2, 3)))


@query(""", d AS (SELECT store, product, week_idx, demand - avg(demand) OVER (PARTITION BY store, product) d FROM panel), p AS (SELECT store, product, period, power(sum(d * cos(week_idx * 2 * pi() / period)), 2) + power(sum(d * sin(week_idx * 2 * pi() / period)), 2) pw FROM d, (SELECT unnest(range(2, 100)) period) GROUP BY ALL)
SELECT store, product, CAST(period AS INTEGER) period, CAST(row_number() OVER (PARTITION BY store, product ORDER BY round(pw, 4) DESC, period) AS INTEGER) AS rank, round(pw, 2) AS power FROM p QUALIFY row_number() OVER (PARTITION BY store, product ORDER BY round(pw, 4) DESC, period) <= 5""")
def k16_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest periods of each series (a top-k report)."""
    rows = statistics.periodogram(demand_panel(spark, sf_dir), KEYS, "week_idx", "demand", list(range(2, 100)))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(F.round("power", 4)), "period"))
    return rows.select(*KEYS, "period", rank.alias("rank"), F.round("power", 2).alias("power")).where("rank <= 5")


@query(", t AS (SELECT week_idx, sum(demand) total FROM panel GROUP BY ALL) SELECT week_idx, total, lag(total, 1) OVER (ORDER BY week_idx) lag_1, round(avg(total) OVER (ORDER BY week_idx ROWS 3 PRECEDING), 6) mean_4 FROM t")
def k18_weekly_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total series (a row per week) with lags and rolling means."""
    t = demand_panel(spark, sf_dir).groupBy("week_idx").agg(F.sum("demand").alias("total"))
    by = Window.orderBy("week_idx")
    return t.select("week_idx", "total", F.lag("total").over(by).alias("lag_1"), F.round(F.avg("total").over(by.rowsBetween(-3, 0)), 6).alias("mean_4"))


@query(_PMF_SQL + ", g AS (SELECT store, product, -sum(p * ln(p)) h, sum(x * x * p) - sum(x * p) ** 2 v FROM pmf GROUP BY ALL) SELECT store, product, round(h, 6) entropy, round(0.5 * ln(2 * pi() * exp(1) * (v + 1.0 / 12)), 6) gaussian, round(0.5 * ln(2 * pi() * exp(1) * (v + 1.0 / 12)) - h, 6) gap FROM g")
def l1_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, p = F.col("x"), F.col("p")
    h, v = statistics.entropy(p), F.sum(x * x * p) - F.sum(x * p) ** 2
    normal = 0.5 * F.ln(2 * 3.141592653589793 * 2.718281828459045 * (v + 1.0 / 12))
    return _pmf(spark, sf_dir).groupBy(*KEYS).agg(F.round(h, 6).alias("entropy"), F.round(normal, 6).alias("gaussian"), F.round(normal - h, 6).alias("gap"))


@query(_STOCK_SQL + ", c AS (SELECT store, product, round(0.2 * greatest(20 - x, 0) + greatest(x - 20, 0), 9) AS cost, sum(p) p FROM net GROUP BY ALL), m AS (SELECT store, product, sum(x * p) mx FROM net GROUP BY ALL) SELECT c.store, c.product, round(sum(cost * p), 6) expected_cost, round(-sum(p * ln(p)), 6) cost_entropy, round(sum(cost * p) - any_value(0.2 * greatest(20 - mx, 0) + greatest(mx - 20, 0)), 6) jensen_gap FROM c JOIN m ON c.store = m.store AND c.product = m.product GROUP BY c.store, c.product")
def l2_l3_cost_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the cost of ordering 20: mean, entropy, and the mean less the cost of the mean."""
    pmf = _pmf(spark, sf_dir)
    net = inventory.convolve(pmf, inventory.leftover(pmf, _stock(demand_panel(spark, sf_dir)), KEYS), KEYS, F.col("xa") - F.col("xb"))
    cost = lambda x: 0.2 * F.greatest(20 - x, F.lit(0.0)) + F.greatest(x - 20, F.lit(0.0))
    c = net.groupBy(*KEYS, F.round(cost(F.col("x").cast("double")), 9).alias("cost")).agg(F.sum("p").alias("p"))
    c = c.groupBy(*KEYS).agg(F.sum(F.col("cost") * F.col("p")).alias("e"), statistics.entropy(F.col("p")).alias("h"))
    m = net.groupBy(*KEYS).agg(F.sum(F.col("x") * F.col("p")).alias("mx"))
    return c.join(m, KEYS).select(*KEYS, F.round("e", 6).alias("expected_cost"), F.round("h", 6).alias("cost_entropy"), F.round(F.col("e") - cost(F.col("mx")), 6).alias("jensen_gap"))


@query(_PMF_SQL + ", m AS (SELECT x, avg(p) pm FROM (SELECT x, sum(p) p FROM pmf GROUP BY store, product, x) GROUP BY x) SELECT store, product, round(sum(p * ln(p / greatest(pm, 1e-6))), 6) kl FROM pmf JOIN m USING (x) GROUP BY ALL")
def l4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each series' distribution from the mean probability of each value."""
    pmf = _pmf(spark, sf_dir)
    m = pmf.groupBy("x").agg(F.avg("p").alias("pm"))
    return pmf.join(m, "x").groupBy(*KEYS).agg(F.round(F.sum(F.col("p") * F.ln(F.col("p") / F.greatest(F.col("pm"), F.lit(1e-6)))), 6).alias("kl"))


@query(""", l AS (SELECT store, product, demand, lag(demand) OVER (PARTITION BY store, product ORDER BY week_idx) l FROM panel), b AS (SELECT store, product, CASE WHEN demand = 0 THEN 0 WHEN demand <= 25 THEN 1 ELSE 2 END x, CASE WHEN l = 0 THEN 0 WHEN l <= 25 THEN 1 ELSE 2 END y FROM l WHERE l IS NOT NULL),
c AS (SELECT store, product, x, y, count(*) c FROM b GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY store, product) n, sum(c) OVER (PARTITION BY store, product, x) nx, sum(c) OVER (PARTITION BY store, product, y) ny FROM c)
SELECT store, product, round(sum(c / n * ln(c * n / (nx * ny))), 6) mi FROM t GROUP BY ALL""")
def l5_l7_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information of last week's demand class about this week's."""
    kind = lambda c: F.when(F.col(c) == 0, 0).when(F.col(c) <= 25, 1).otherwise(2)
    rows = demand_panel(spark, sf_dir).withColumn("l", F.lag("demand").over(X.ordered())).where("l is not null").select(*KEYS, kind("demand").alias("x"), kind("l").alias("y"))
    return statistics.mutual_information(rows, KEYS, "x", "y").withColumn("mi", F.round("mi", 6))


@query(""", r AS (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY week_idx DESC) rn FROM panel), s AS (SELECT store, product, stddev_pop(demand) / avg(abs(demand)) cv, regr_slope(demand, CAST(week_idx AS DOUBLE)) b FROM r WHERE rn <= 26 GROUP BY ALL)
SELECT store, product, CASE WHEN cv IS NULL THEN 'unknown' WHEN cv > 1 THEN 'volatile' WHEN abs(b) > 0.5 THEN 'trending' ELSE 'stable' END regime FROM s""")
def l8_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("week_idx")))
    s = demand_panel(spark, sf_dir).withColumn("rn", rn).where("rn <= 26").groupBy(*KEYS).agg(F.try_divide(F.stddev_pop("demand"), F.avg(F.abs("demand"))).alias("cv"), F.regr_slope(F.col("demand"), F.col("week_idx").cast("double")).alias("b"))
    return s.select(*KEYS, F.when(F.col("cv").isNull(), "unknown").when(F.col("cv") > 1, "volatile").when(F.abs("b") > 0.5, "trending").otherwise("stable").alias("regime"))


@query(""", s AS (SELECT store, product, avg(demand) m, stddev_pop(demand) / avg(demand) cv FROM panel GROUP BY ALL), r AS (SELECT store, rank() OVER (PARTITION BY store ORDER BY m) + (count(*) OVER (PARTITION BY store, m) - 1) / 2.0 a, rank() OVER (PARTITION BY store ORDER BY cv) + (count(*) OVER (PARTITION BY store, cv) - 1) / 2.0 b FROM s)
SELECT store, round(corr(a, b), 6) spearman FROM r GROUP BY ALL""")
def l10_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of series' means and variations within each store."""
    s = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.avg("demand").alias("m"), (F.stddev_pop("demand") / F.avg("demand")).alias("cv"))
    r = s.select("store", statistics.average_rank("m", ["store"]).alias("a"), statistics.average_rank("cv", ["store"]).alias("b"))
    return r.groupBy("store").agg(F.round(F.corr("a", "b"), 6).alias("spearman"))


@query(_LEDGER_SQL + ", t AS (SELECT store, product, sum(holding_cost + shortage_cost) FILTER (week_idx < 178) a, sum(holding_cost + shortage_cost) FILTER (week_idx >= 178) b FROM ledger GROUP BY ALL) SELECT store, round(avg(b - a), 6) mean_delta, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) share_better, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 5) t FROM t GROUP BY ALL")
def l13_paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the second half against the first, series by series."""
    cost = F.col("holding_cost") + F.col("shortage_cost")
    t = _ledger(spark, sf_dir).groupBy(*KEYS).agg(F.sum(F.when(F.col("week_idx") < 178, cost)).alias("a"), F.sum(F.when(F.col("week_idx") >= 178, cost)).alias("b"))
    d = F.col("b") - F.col("a")
    return t.groupBy("store").agg(F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.avg((d < 0).cast("double")), 6).alias("share_better"), F.round(F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*"))), 5).alias("t"))


@query(""", s AS (SELECT store, product, sum(demand) v, stddev_pop(demand) / avg(demand) cv FROM panel GROUP BY ALL), c AS (SELECT *, sum(v) OVER (PARTITION BY store ORDER BY v DESC, product) / sum(v) OVER (PARTITION BY store) share FROM s)
SELECT store, product, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END abc, CASE WHEN cv <= 0.9 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END xyz FROM c""")
def j29_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by running share of each store's volume and by variation."""
    s = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.sum("demand").alias("v"), (F.stddev_pop("demand") / F.avg("demand")).alias("cv"))
    share = F.sum("v").over(Window.partitionBy("store").orderBy(F.desc("v"), "product").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(Window.partitionBy("store"))
    return s.select(*KEYS, F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C").alias("abc"), F.when(F.col("cv") <= 0.9, "X").when(F.col("cv") <= 1.0, "Y").otherwise("Z").alias("xyz"))


_BOARD_SQL = "WITH b AS (SELECT c_name AS name, CAST(year(o_orderdate) AS INTEGER) AS wk, sum(o_totalprice) AS cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY wk ORDER BY round(cost, 2)) AS rk, count(*) OVER (PARTITION BY wk) n FROM b)"


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    b = rows.groupBy(F.col("c_name").alias("name"), F.year("o_orderdate").alias("wk")).agg(F.sum("o_totalprice").alias("cost"))
    return b.select("*", F.rank().over(Window.partitionBy("wk").orderBy(F.round("cost", 2))).alias("rk"), F.count("*").over(Window.partitionBy("wk")).alias("n"))


@query(_BOARD_SQL + " SELECT name, count(*) AS weeks, round(arg_max(cost, wk), 2) final_cost, round(stddev_pop(cost), 4) volatility, round(stddev_pop(cost) / avg(cost), 6) cv, round(CASE WHEN count(*) > 1 THEN regr_slope(cost, wk::DOUBLE) ELSE 0 END, 3) + 0.0 trend FROM r GROUP BY ALL", panel=False)
def m1_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).groupBy("name").agg(F.count("*").alias("weeks"), F.round(F.max_by("cost", "wk"), 2).alias("final_cost"), F.round(F.stddev_pop("cost"), 4).alias("volatility"), F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cv"), (F.round(F.when(F.count("*") > 1, F.regr_slope(F.col("cost"), F.col("wk").cast("double"))).otherwise(0.0), 3) + 0.0).alias("trend"))


@query(_BOARD_SQL + " SELECT name, wk, CAST(lead(rk) OVER (PARTITION BY name ORDER BY wk) - rk AS INTEGER) rank_change FROM r", panel=False)
def m2_rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select("name", "wk", (F.lead("rk").over(Window.partitionBy("name").orderBy("wk")) - F.col("rk")).alias("rank_change"))


@query(_BOARD_SQL + " SELECT wk, round(max(cost) FILTER (rk <= ceil(n * 0.2)), 2) threshold, count(*) FILTER (rk <= ceil(n * 0.2)) n_top FROM r GROUP BY ALL", panel=False)
def m3_top_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("rk") <= F.ceil(F.col("n") * 0.2)
    return _board(spark, sf_dir).groupBy("wk").agg(F.round(F.max(F.when(top, F.col("cost"))), 2).alias("threshold"), F.count(F.when(top, 1)).alias("n_top"))


@query(_BOARD_SQL + " SELECT wk, count(*) n, round(avg(cost), 2) mean, round(quantile_cont(cost, 0.1), 2) p10, round(quantile_cont(cost, 0.5), 2) p50, round(quantile_cont(cost, 0.9), 2) p90 FROM r GROUP BY ALL", panel=False)
def m4_cost_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.round(F.percentile("cost", F.lit(p)), 2)
    return _board(spark, sf_dir).groupBy("wk").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 2).alias("mean"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"))


@query(_BOARD_SQL + " SELECT a.wk, round(corr(a.cost, b.cost), 5) pearson, round(corr(a.rk, b.rk), 5) spearman, round(avg(CASE WHEN ceil(4.0 * a.rk / a.n) = ceil(4.0 * b.rk / b.n) THEN 1.0 ELSE 0.0 END), 6) same_quartile FROM r a JOIN r b ON a.name = b.name AND b.wk = a.wk + 1 GROUP BY a.wk", panel=False)
def m5_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a year's costs and ranks carry over to the next."""
    r = _board(spark, sf_dir)
    b = r.select("name", (F.col("wk") - 1).alias("wk"), F.col("cost").alias("cost_b"), F.col("rk").alias("rk_b"), F.col("n").alias("n_b"))
    same = (F.ceil(4.0 * F.col("rk") / F.col("n")) == F.ceil(4.0 * F.col("rk_b") / F.col("n_b"))).cast("double")
    return r.join(b, ["name", "wk"]).groupBy("wk").agg(F.round(F.corr("cost", "cost_b"), 5).alias("pearson"), F.round(F.corr("rk", "rk_b"), 5).alias("spearman"), F.round(F.avg(same), 6).alias("same_quartile"))


@query(_LEDGER_SQL + " SELECT store, product, week_idx, leftover < 0.001 AND sold >= on_hand_start + arriving - 0.001 AS stockout FROM ledger")
def d1_stockout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = (F.col("leftover") < 0.001) & (F.col("sold") >= F.col("on_hand_start") + F.col("arriving") - 0.001)
    return _ledger(spark, sf_dir).select(*KEYS, "week_idx", empty.alias("stockout"))


@query(_PMF_SQL + ", s AS (SELECT pmf.*, on_hand FROM pmf JOIN state USING (store, product)) SELECT store, product, round(sum(x * p) FILTER (x >= on_hand) / sum(p) FILTER (x >= on_hand), 6) tail_mean, round(sum(p * greatest(x - on_hand, 0)), 6) expected_excess FROM s GROUP BY ALL")
def d2_expected_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean demand given that it reaches the stock, and the mean beyond it; no tail gives null."""
    s = _pmf(spark, sf_dir).join(state(demand_panel(spark, sf_dir)), KEYS)
    tail = F.col("x") >= F.col("on_hand")
    mean = F.try_divide(F.sum(F.when(tail, F.col("x") * F.col("p"))), F.sum(F.when(tail, F.col("p"))))
    return s.groupBy(*KEYS).agg(F.round(mean, 6).alias("tail_mean"), F.round(F.sum(F.col("p") * F.greatest(F.col("x") - F.col("on_hand"), F.lit(0.0))), 6).alias("expected_excess"))


_NEAR_SQL = """, pr AS (SELECT *, avg(demand) OVER w m4, coalesce(stddev_pop(demand) OVER w, 0) s4, weekofyear(week) iso FROM panel WINDOW w AS (PARTITION BY store, product ORDER BY week_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
nb AS (SELECT t.store, t.product, t.week_idx, t.demand, c.store cs, c.week_idx cw, c.demand cd, abs(t.m4 - c.m4) + 0.5 * abs(t.s4 - c.s4) dist FROM pr t JOIN pr c ON t.product = c.product AND c.in_stock AND NOT t.in_stock AND t.week_idx >= 104 AND c.week_idx >= 4 AND c.week_idx < t.week_idx AND abs(t.iso - c.iso) <= 2),
kn AS (SELECT *, row_number() OVER (PARTITION BY store, product, week_idx ORDER BY round(dist, 6), cs, cw) rn FROM nb)"""


def _neighbours(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """For each stock-out week, the k in-stock weeks most like it: the same product, earlier, at most two ISO weeks apart."""
    over = X.ordered().rowsBetween(-4, -1)
    rows = demand_panel(spark, sf_dir).select(*KEYS, "week_idx", "demand", "in_stock", F.avg("demand").over(over).alias("m4"), F.coalesce(F.stddev_pop("demand").over(over), F.lit(0.0)).alias("s4"), F.weekofyear("week").alias("iso"))
    targets = rows.where("not in_stock and week_idx >= 104").select(*KEYS, "week_idx", "demand", "m4", "s4", F.explode(F.sequence(F.col("iso") - 2, F.col("iso") + 2)).alias("iso"))
    past = rows.where("in_stock and week_idx >= 4").select(F.col("store").alias("cs"), "product", F.col("week_idx").alias("cw"), F.col("demand").alias("cd"), F.col("m4").alias("cm"), F.col("s4").alias("c4"), "iso")
    near = targets.join(past, ["product", "iso"]).where("cw < week_idx")
    near = near.withColumn("dist", F.abs(F.col("m4") - F.col("cm")) + 0.5 * F.abs(F.col("s4") - F.col("c4")))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "week_idx").orderBy(F.round("dist", 6), "cs", "cw"))
    return near.withColumn("rn", rank).where(F.col("rn") <= k)


@query(_NEAR_SQL + ", im AS (SELECT store, product, week_idx, greatest(any_value(demand), quantile_cont(cd, 0.5)) filled FROM kn WHERE rn <= 10 GROUP BY ALL) SELECT p.store, p.product, p.week_idx, coalesce(filled, p.demand) demand, filled IS NOT NULL AS imputed FROM panel p LEFT JOIN im USING (store, product, week_idx)")
def d9_imputed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-out weeks filled with their neighbours' median, what sold at least."""
    filled = _neighbours(spark, sf_dir).groupBy(*KEYS, "week_idx").agg(F.greatest(F.first("demand"), F.percentile("cd", F.lit(0.5))).alias("filled"))
    rows = demand_panel(spark, sf_dir).join(filled, [*KEYS, "week_idx"], "left")
    return rows.select(*KEYS, "week_idx", F.coalesce("filled", "demand").alias("demand"), F.col("filled").isNotNull().alias("imputed"))
