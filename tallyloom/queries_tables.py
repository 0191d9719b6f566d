"""Registered queries: reading, aligning, auditing and writing tables, with their oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.bindings import KEYS, demand_panel, given_orders, read, state
from .registry import query
from .sources import retail


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared folder; in a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).where("week_idx >= 52 and week_idx < 104")


@query("SELECT store, product, week, demand FROM panel WHERE week_idx >= 52 AND week_idx < 104")
def a1_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "wide")
    retail.long_to_wide(_year(spark, sf_dir)).write.option("header", True).csv(path)
    return retail.wide_to_long(retail.normalised_keys(spark.read.option("header", True).csv(path)))


@query("SELECT store, product, week, CASE WHEN week_idx >= 98 THEN demand + 1 ELSE demand END demand FROM panel WHERE week_idx >= 52 AND week_idx < 104")
def a2_append_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _year(spark, sf_dir)
    files = [rows.where(F.col("week_idx") == w).select(*KEYS, "week", (F.col("demand") + 1).alias("demand")) for w in range(98, 104)]
    return retail.with_files(rows.select(*KEYS, "week", "demand"), *files)


@query("SELECT store, product, week, demand, CASE WHEN week_idx % 2 = 0 THEN in_stock ELSE true END in_stock FROM panel")
def a3_stock_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir)
    return retail.with_flags(rows.select(*KEYS, "week", "demand"), rows.where("week_idx % 2 = 0"))


_TEMPLATE_SQL = ", template AS (SELECT store, product, CAST(row_number() OVER (ORDER BY store, product) AS INTEGER) AS ord FROM (SELECT DISTINCT store, product FROM panel))"


def _template(panel: DataFrame) -> DataFrame:
    """Canonical keys with their order; a key list is small (one row per series)."""
    return panel.select(*KEYS).distinct().withColumn("ord", F.row_number().over(Window.orderBy(*KEYS)))


@query(_TEMPLATE_SQL + " SELECT ord, t.store, t.product, coalesce(on_hand, intransit_1, 0.0) on_hand, coalesce(intransit_2, 0.0) intransit FROM template t LEFT JOIN (SELECT * FROM state WHERE (store + product) % 3 <> 0) s ON s.store = t.store AND s.product = t.product")
def a4_a5_aligned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    some = state(panel).where("(store + product) % 3 <> 0")
    return retail.aligned(_template(panel), some, {"on_hand": ["on_hand", "intransit_1"], "intransit": ["intransit_2"]})


@query("SELECT p_partkey part_key, p_brand part_brand, p_size part_size FROM part", panel=False)
def a6_a7_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias(" Part Key"), F.col("p_brand").alias("Part  Brand"), F.col("p_size").alias("PART-SIZE"))
    return retail.normalised(rows)


_QUANTILES_SQL = """, e AS (SELECT store, product, quantile_cont(demand, 0.1) a, quantile_cont(demand, 0.9) b FROM panel GROUP BY ALL),
f AS (SELECT store, product, CAST(step AS INTEGER) step, tau, round(a * (1 - tau) + b * tau + step, 6) AS value FROM e, (SELECT unnest(range(1, 4)) step), (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) tau))"""


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = demand_panel(spark, sf_dir).groupBy(*KEYS).agg(F.percentile("demand", F.lit(0.1)).alias("a"), F.percentile("demand", F.lit(0.9)).alias("b"))
    rows = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")).select("*", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("tau"))
    return rows.select(*KEYS, "step", "tau", F.round(F.col("a") * (1 - F.col("tau")) + F.col("b") * F.col("tau") + F.col("step"), 6).alias("value"))


@query(_QUANTILES_SQL + " SELECT * FROM f")
def a8_quantile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "quantiles")
    retail.save_quantiles(_forecast(spark, sf_dir), path)
    return retail.load_quantiles(spark, path).select(*KEYS, "step", "tau", "value")


@query(_QUANTILES_SQL + " SELECT a.store, a.product, CAST(k AS INTEGER) fold_idx, a.step, a.tau, CASE WHEN (a.product + k) % 2 = 0 THEN a.value + k ELSE a.value END AS value FROM f a, (SELECT unnest(range(3)) k)")
def a9_fold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's own forecast where stored, else fold 0's."""
    base = _forecast(spark, sf_dir)
    keys = [*KEYS, "step", "tau"]
    folds = base.select(*keys, "value", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold_idx")).withColumn("value", F.col("value") + F.col("fold_idx"))
    stored = folds.where("(product + fold_idx) % 2 = 0 or fold_idx = 0")
    wanted = folds.select(*keys, "fold_idx")
    zero = stored.where("fold_idx = 0").select(*keys, F.col("value").alias("zero"))
    return wanted.join(stored, [*keys, "fold_idx"], "left").join(zero, keys).select(*keys, "fold_idx", F.coalesce("value", "zero").alias("value"))


@query("SELECT store, product, CAST(k AS INTEGER) fold_idx, CASE WHEN k = 1 AND product % 2 = 0 THEN on_hand + 5 WHEN product % 3 <> 0 THEN on_hand ELSE 0.0 END on_hand FROM state, (SELECT unnest(range(2)) k)")
def a10_state_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold's row, else the series' row, else nothing on hand."""
    every = state(demand_panel(spark, sf_dir))
    wanted = every.select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1))).alias("fold_idx"))
    by_fold = every.where("product % 2 = 0").select(*KEYS, F.lit(1).alias("fold_idx"), (F.col("on_hand") + 5).alias("own"))
    by_key = every.where("product % 3 <> 0").select(*KEYS, "on_hand")
    return wanted.join(by_fold, [*KEYS, "fold_idx"], "left").join(by_key, KEYS, "left").select(*KEYS, "fold_idx", F.coalesce("own", "on_hand", F.lit(0.0)).alias("on_hand"))


@query("SELECT store, product, CAST(week_idx - 348 AS INTEGER) AS week, CAST(demand AS INTEGER) actual_demand FROM panel WHERE week_idx >= 349")
def a11_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_panel(spark, sf_dir).where("week_idx >= 349").select(*KEYS, (F.col("week_idx") - 348).alias("week"), F.col("demand").cast("int").alias("actual_demand"))


@query(", d AS (SELECT DISTINCT week AS decision_date FROM panel WHERE week_idx % 50 = 49) SELECT decision_date, count(*) n_rows, max(week) last_week, CAST(sum(CASE WHEN week >= decision_date THEN 1 ELSE 0 END) AS BIGINT) n_leaks FROM d JOIN panel ON week < decision_date GROUP BY ALL")
def a12_a13_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand_panel(spark, sf_dir)
    decisions = rows.where("week_idx % 50 = 49").select(F.col("week").alias("decision_date")).distinct()
    return retail.leak_audit(retail.snapshot(rows, decisions))


@query()
def a14_scenarios_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly demand by store as named scenarios, written as XML and read back."""
    path = scratch(spark, "scenarios")
    rows = demand_panel(spark, sf_dir).groupBy("store", "week_idx").agg(F.sum("demand").alias("value")).select(F.concat(F.lit("store_"), F.col("store")).alias("name"), F.col("week_idx").alias("scenario_id"), "value")
    retail.write_scenarios_xml(rows, path)
    back = spark.read.format("xml").option("rowTag", "SIP").load(path)
    return back.select(F.col("_name").alias("name"), F.col("_count").alias("n"), F.round("_average", 6).alias("mean"), F.round(F.col("_median").cast("double"), 6).alias("median"))


@query(_TEMPLATE_SQL + " SELECT ord, t.store, t.product, CAST(coalesce(round_even(order_qty + 0.5, 0), 0) AS INTEGER) order_qty FROM template t LEFT JOIN (SELECT * FROM orders_given WHERE week_idx = 300 AND product % 4 <> 0) o ON o.store = t.store AND o.product = t.product")
def a15_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    some = given_orders(panel).where("week_idx = 300 and product % 4 <> 0").select(*KEYS, (F.col("order_qty") + 0.5).alias("order_qty"))
    return retail.submission(_template(panel), some)


@query(", r AS (SELECT store, product, order_qty - 3 q FROM orders_given WHERE week_idx = 300 AND product <> 7) SELECT (SELECT count(*) FROM r) n_rows, 0::BIGINT n_null, (SELECT count(*) FROM r WHERE q < 0) n_negative, (SELECT count(*) FROM (SELECT DISTINCT store, product FROM panel WHERE product = 7)) n_missing, 0::BIGINT n_unknown")
def a16_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = demand_panel(spark, sf_dir)
    rows = given_orders(panel).where("week_idx = 300 and product <> 7").select(*KEYS, (F.col("order_qty") - 3).alias("order_qty"))
    return retail.validate_submission(_template(panel), rows)


@query("SELECT 'base' AS run, store, product, sum(demand) total FROM panel WHERE week_idx < 100 GROUP BY ALL UNION ALL SELECT 'v2', store, product, sum(demand) FROM panel WHERE week_idx >= 100 GROUP BY ALL")
def a18_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results of a run are replaced by new ones under its label."""
    rows = demand_panel(spark, sf_dir)
    total = lambda some, run: rows.where(some).groupBy(*KEYS).agg(F.sum("demand").alias("total")).select(F.lit(run).alias("run"), *KEYS, "total")
    old = total("week_idx < 100", "base").unionByName(total("week_idx < 50", "v2_old"))
    return old.where(~F.col("run").startswith("v2")).unionByName(total("week_idx >= 100", "v2"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS \"year\", CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY sum(o_totalprice), c_name) AS INTEGER) AS rank, c_name AS name, CAST(count(*) AS INTEGER) apply_count, round(sum(o_totalprice), 2) order_cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY year(o_orderdate), c_name", panel=False)
def a19_leaderboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly boards of customers rendered as texts of three lines a record, a thousand ranks in each, parsed back to rows. Costs are added
    in the order of order keys: the last digit of a sum of doubles, and with it the rank, doesn't depend on which task meets which order first."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    prices = F.array_sort(F.collect_list(F.when(F.col("o_totalprice").isNotNull(), F.struct("o_orderkey", "o_totalprice"))))
    total = F.aggregate(prices, F.lit(0.0), lambda s, x: s + x["o_totalprice"])
    cost = rows.groupBy(F.year("o_orderdate").alias("year"), F.col("c_name").alias("name")).agg(F.when(F.count("o_totalprice") > 0, total).alias("cost"), F.count("*").alias("n"))
    cost = cost.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy("cost", "name")))
    money = F.format_number("cost", 2)
    record = F.concat_ws("\n", F.col("rank").cast("string"), "name", F.concat_ws("\t", F.col("n").cast("string"), money, money, F.col("n").cast("string"), F.lit("today")))
    text = cost.select("year", "rank", record.alias("r")).groupBy("year", F.expr("(rank - 1) div 1000").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]), "\n").alias("text"))
    return retail.parse_leaderboard(text).select("year", "rank", "name", "apply_count", "order_cost")


@query("SELECT store, product, CAST(right(c, 1) AS INTEGER) + 299 AS week_idx, q AS order_qty FROM (UNPIVOT (SELECT store, product, max(order_qty) FILTER (week_idx = 300) week_1, max(order_qty) FILTER (week_idx = 301) week_2 FROM orders_given GROUP BY ALL) ON week_1, week_2 INTO NAME c VALUE q)")
def a20_order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly order columns of a wide submission as rows."""
    rows = given_orders(demand_panel(spark, sf_dir)).where("week_idx in (300, 301)").withColumn("c", F.concat(F.lit("week_"), F.col("week_idx") - 299))
    wide = rows.groupBy(*KEYS).pivot("c").agg(F.first("order_qty"))
    return wide.unpivot(KEYS, ["week_1", "week_2"], "c", "order_qty").select(*KEYS, (F.substring("c", 6, 1).cast("int") + 299).alias("week_idx"), "order_qty")


@query("SELECT store, week_idx, sum(demand) revenue_units FROM panel WHERE week_idx BETWEEN 300 AND 303 GROUP BY ALL")
def a21_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly files, the week taken from each file's folder name."""
    path = scratch(spark, "weekly")
    demand_panel(spark, sf_dir).where("week_idx between 300 and 303").withColumn("wk", F.col("week_idx")).write.partitionBy("wk").parquet(path)
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/wk={w}" for w in range(300, 304)))
    week = F.regexp_extract(F.input_file_name(), r"wk=(\d+)", 1).cast("int")
    return rows.groupBy("store", week.alias("week_idx")).agg(F.sum("demand").alias("revenue_units"))
