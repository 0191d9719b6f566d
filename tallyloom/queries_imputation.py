"""Registered queries: stock-out weeks rebuilt from similar weeks, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import transforms as T
from .operators import imputation as M
from .operators.forecasts import LEVELS
from .plans.bindings import KEYS, demand_panel
from .queries_tables import scratch
from .registry import query

_LEVELS = "[0.01,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.95,0.99]::DOUBLE[]"
_BY = "PARTITION BY store, product ORDER BY week_idx"
_NEIGHBOURS_SQL = f""", y AS (SELECT *, lag(demand, 1) OVER w y1, lag(demand, 2) OVER w y2, lag(demand, 3) OVER w y3, lag(demand, 4) OVER w y4, count(*) OVER b n, coalesce(avg(demand) OVER b, 0) AS level, coalesce(stddev_pop(demand) OVER b, 0) deviation, weekofyear(week) iso
  FROM panel WINDOW w AS ({_BY}), b AS ({_BY} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
pf AS (SELECT *, CASE n WHEN 4 THEN (1.5 * y1 + 0.5 * y2 - 0.5 * y3 - 1.5 * y4) / 5 WHEN 3 THEN (y1 - y3) / 2 WHEN 2 THEN y1 - y2 ELSE 0 END trend, deviation / (level + 1e-9) variation, avg(demand) OVER (PARTITION BY store, product, iso) season FROM y),
pairs AS (SELECT t.store, t.product, t.week_idx, t.demand, c.store c_store, c.product c_product, c.week_idx c_week_idx, c.demand c_demand,
  0.3 * (abs(t.level - c.level) / (abs(t.level) + 1e-6)) + 0.3 * abs(t.variation - c.variation) + 0.2 * (abs(t.season - c.season) / (abs(t.season) + 1e-6)) + 0.1 * (abs(t.trend - c.trend) / (abs(t.trend) + 1e-6)) + CASE WHEN t.product = c.product THEN 0 ELSE 0.1 END distance
  FROM pf t JOIN pf c ON t.product // 4 = c.product // 4 AND c.in_stock AND NOT t.in_stock AND c.week_idx < t.week_idx AND abs(t.iso - c.iso) <= 2),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, product, week_idx ORDER BY round(distance, 6), c_store, c_product, c_week_idx) place FROM pairs) WHERE place <= 20)"""


def _z(value: str, name: str = "transform") -> str:
    return f"CASE {name} WHEN 'identity' THEN {value} WHEN 'log' THEN ln(greatest({value}, 1e-6)) WHEN 'log1p' THEN ln(1 + {value}) WHEN 'sqrt' THEN sqrt({value}) ELSE cbrt({value}) END"


_TARGETS_SQL = f""", c AS (SELECT store, product, t.n AS transform, {_z('demand', 't.n')} z FROM panel, (SELECT unnest(['identity','log','log1p','sqrt','cbrt']) n) t WHERE demand > 0),
v AS (SELECT store, product, transform, stddev_pop(z) / abs(avg(z)) cv FROM c GROUP BY ALL HAVING abs(avg(z)) > 1e-9), names AS (SELECT store, product, arg_min(transform, (round(cv, 9), transform)) AS transform FROM v GROUP BY ALL),
tg AS (SELECT *, {_z('stock')} AS level FROM (SELECT p.store, p.product, p.week_idx, p.demand stock, coalesce(n.transform, 'log') AS transform FROM panel p LEFT JOIN names n USING (store, product) WHERE NOT in_stock))"""
_SPLICE_SQL = """, stretched AS (SELECT store, product, week_idx, start, level, [list_extract(rest, CAST(floor(t * (len(rest) - 1)) AS INTEGER) + 1) + (list_extract(rest, least(CAST(floor(t * (len(rest) - 1)) AS INTEGER) + 2, len(rest))) - list_extract(rest, CAST(floor(t * (len(rest) - 1)) AS INTEGER) + 1)) * (t * (len(rest) - 1) - floor(t * (len(rest) - 1))) FOR t IN levels[start + 1 : 13]] AS tail
  FROM (SELECT *, [q FOR q IN f IF q >= level - 1e-9] AS rest, LEVELS AS levels FROM functions) WHERE len(rest) > 0),
middles AS (SELECT store, product, week_idx, list(m ORDER BY i) AS own FROM (SELECT store, product, week_idx, i, quantile_cont(tail[i], 0.5) AS m FROM stretched, range(1, 14) AS r(i) WHERE i <= len(tail) GROUP BY ALL) GROUP BY ALL),
spliced AS (SELECT o.store, o.product, o.week_idx, CASE WHEN start = 13 THEN observed
    WHEN own IS NULL THEN list_concat(head, [CASE WHEN start > 1 THEN level * (1 + list_stddev_pop(head) / (list_avg(head) + 1e-9) * i) ELSE level * 1.5 END FOR i IN range(1, 14 - start)])
    WHEN start > 0 THEN list_concat(head, [list_max([x + head[start] - own[1] FOR x IN own[1 : i]]) FOR i IN range(1, 14 - start)]) ELSE own END AS f
  FROM (SELECT *, observed[1 : start] AS head FROM observed) o LEFT JOIN middles USING (store, product, week_idx))""".replace("LEVELS", _LEVELS)


def _names(panel: DataFrame) -> DataFrame:
    return T.best_by_variation(panel, KEYS)


def _wide(rows: DataFrame, name: str) -> DataFrame:
    """A row per level, rounded."""
    return M.long(rows.withColumnRenamed(name, "quantiles")).withColumn("value", F.round("value", 6))


@query(_NEIGHBOURS_SQL + " SELECT store, product, week_idx, c_store, c_product, c_week_idx, round(distance, 6) distance, CAST(place AS INTEGER) place FROM near")
def d3_d4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest in-stock weeks of every stock-out week, by weighted profile distance."""
    return M.neighbours(demand_panel(spark, sf_dir)).select(*M.TARGET, "c_store", "c_product", "c_week_idx", F.round("distance", 6).alias("distance"), "place")


@query(_TARGETS_SQL + f""", past AS (SELECT t.store, t.product, t.week_idx, quantile_cont(z, {_LEVELS}) q FROM (SELECT tg.*, {_z('p.demand')} z FROM tg JOIN panel p ON p.store = tg.store AND p.product = tg.product AND p.week_idx < tg.week_idx) t WHERE z < level GROUP BY ALL)
SELECT store, product, week_idx, quantile, round(CASE WHEN value < level THEN value END, 6) AS value FROM (SELECT tg.store, tg.product, tg.week_idx, level, unnest({_LEVELS}) quantile, unnest(coalesce(q, [NULL::DOUBLE FOR i IN range(13)])) AS value FROM tg LEFT JOIN past USING (store, product, week_idx))""")
def d5_below_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles, in each series' transform, of the past sales under what sold in a stock-out week; null without such sales."""
    panel = demand_panel(spark, sf_dir)
    forward = lambda x: T.apply(F.col("transform"), x, T.FORWARD)
    rows = panel.where("not in_stock").select(*M.TARGET, "demand").join(_names(panel).select(*KEYS, "transform"), KEYS, "left").withColumn("transform", F.coalesce("transform", F.lit("log")))
    values = F.transform(F.filter("history", lambda h: h["week_idx"] < F.col("week_idx")), lambda h: forward(h["demand"]))
    rows = rows.join(M.histories(panel), KEYS).withColumns({"values": values, "level": forward(F.col("demand"))})
    return _wide(M.below(rows, "values", "level"), "observed")


@query(_NEIGHBOURS_SQL + f""", hist AS (SELECT p.store, p.product, p.week_idx, quantile_cont(h.demand, {_LEVELS}) f FROM (SELECT DISTINCT c_store store, c_product product, c_week_idx week_idx FROM near) p JOIN panel h ON h.store = p.store AND h.product = p.product AND h.week_idx <= p.week_idx GROUP BY ALL),
observed AS (SELECT *, len([q FOR q IN observed IF q IS NOT NULL]) AS start FROM (SELECT store, product, week_idx, level, [CASE WHEN q < level - 1e-9 THEN q END FOR q IN coalesce(aq, [NULL::DOUBLE FOR i IN range(13)])] AS observed
  FROM (SELECT t.store, t.product, t.week_idx, t.demand AS level, quantile_cont(h.demand, {_LEVELS}) aq FROM panel t LEFT JOIN panel h ON h.store = t.store AND h.product = t.product AND h.week_idx < t.week_idx WHERE NOT t.in_stock GROUP BY ALL))),
functions AS (SELECT o.store, o.product, o.week_idx, start, level, f FROM near JOIN observed o USING (store, product, week_idx) JOIN hist ON hist.store = c_store AND hist.product = c_product AND hist.week_idx = c_week_idx){_SPLICE_SQL}
SELECT store, product, week_idx, unnest({_LEVELS}) quantile, round(unnest(f), 6) AS value FROM spliced""")
def d6_tail_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The past's quantiles up to what sold in a stock-out week, and above it the median of the neighbours' tails."""
    return _wide(M.spliced(demand_panel(spark, sf_dir)), "function")


_REBUILT_SQL = _NEIGHBOURS_SQL + _TARGETS_SQL + f""", past AS (SELECT tg.store, tg.product, tg.week_idx, level, {_z('p.demand')} z, p.demand FROM tg JOIN panel p ON p.store = tg.store AND p.product = tg.product AND p.week_idx < tg.week_idx),
lowq AS (SELECT store, product, week_idx, quantile_cont(z, {_LEVELS}) q FROM past WHERE z < level GROUP BY ALL), allq AS (SELECT store, product, week_idx, quantile_cont(demand, {_LEVELS}) aq FROM past GROUP BY ALL),
met AS (SELECT near.store, near.product, near.week_idx, quantile_cont({_z('c_demand')}, {_LEVELS}) sq, var_pop({_z('c_demand')}) variance, count(*) n FROM near JOIN tg USING (store, product, week_idx) GROUP BY ALL),
obs AS (SELECT tg.*, aq, n, variance, CASE WHEN aq IS NULL AND n IS NOT NULL THEN sq ELSE [CASE WHEN x < level THEN x END FOR x IN coalesce(q, [NULL::DOUBLE FOR i IN range(13)])] END AS observed FROM tg LEFT JOIN lowq USING (store, product, week_idx) LEFT JOIN allq USING (store, product, week_idx) LEFT JOIN met USING (store, product, week_idx)),
observed AS (SELECT *, len([x FOR x IN observed IF x IS NOT NULL]) AS start FROM obs),
hist AS (SELECT p.store, p.product, p.week_idx, p.transform, quantile_cont({_z('h.demand')}, {_LEVELS}) f FROM (SELECT DISTINCT c_store store, c_product product, c_week_idx week_idx, transform FROM near JOIN tg USING (store, product, week_idx)) p JOIN panel h ON h.store = p.store AND h.product = p.product AND h.week_idx <= p.week_idx GROUP BY ALL),
functions AS (SELECT o.store, o.product, o.week_idx, start, level, f FROM near JOIN observed o USING (store, product, week_idx) JOIN hist ON hist.store = c_store AND hist.product = c_product AND hist.week_idx = c_week_idx AND hist.transform = o.transform WHERE start < 13){_SPLICE_SQL},
back AS (SELECT o.store, o.product, o.week_idx, o.stock, o.transform, coalesce(n, 0) n_neighbours, aq, CASE WHEN n IS NOT NULL THEN [greatest(0.0, CASE transform WHEN 'identity' THEN z WHEN 'log' THEN exp(z) WHEN 'log1p' THEN exp(z) - 1 WHEN 'sqrt' THEN z * z ELSE z * z * z END * CASE WHEN transform IN ('log', 'log1p') THEN exp(variance / 2) ELSE 1 END) FOR z IN f] END AS b FROM observed o JOIN spliced USING (store, product, week_idx)),
rebuilt AS (SELECT store, product, week_idx, stock, transform, n_neighbours, coalesce(CASE WHEN b IS NOT NULL THEN [list_max(b[1 : i]) FOR i IN range(1, 14)] END, aq, [stock * 2 * i / 12 FOR i IN range(13)]) AS q FROM back)"""


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = demand_panel(spark, sf_dir)
    return panel, M.rebuilt(panel, _names(panel))


@query(_REBUILT_SQL + f" SELECT store, product, week_idx, stock, transform, CAST(n_neighbours AS INTEGER) n_neighbours, round(q[7], 4) median, round(q[13], 3) top, round(list_sum(q), 2) total FROM rebuilt")
def d7_d8_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stock-out week's distribution in its series' transform, with the fallbacks and the correction of logarithms."""
    total = F.aggregate("quantiles", F.lit(0.0), lambda s, x: s + x)
    return _rebuilt(spark, sf_dir)[1].select(*M.TARGET, "stock", "transform", "n_neighbours", F.round(F.col("quantiles")[6], 4).alias("median"), F.round(F.col("quantiles")[12], 3).alias("top"), F.round(total, 2).alias("total"))


@query(_REBUILT_SQL + " SELECT p.store, p.product, p.week_idx, round(coalesce(q[7], demand), 4) demand, q IS NOT NULL AS imputed FROM panel p LEFT JOIN rebuilt USING (store, product, week_idx)")
def d9_training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the medians of rebuilt distributions in stock-out weeks."""
    return M.filled(*_rebuilt(spark, sf_dir)).select(*M.TARGET, F.round("demand", 4).alias("demand"), "imputed")


@query(_REBUILT_SQL + f" SELECT store, product, week_idx, unnest({_LEVELS}) quantile, round(unnest(q), 3) AS value FROM rebuilt")
def a17_imputation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the imputed panel, the distributions and the summary, and reads the distributions back."""
    path = scratch(spark, "imputation")
    M.save(*_rebuilt(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/imputed_sips").select(*M.TARGET, "quantile", F.round("value", 3).alias("value"))
