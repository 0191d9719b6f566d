"""Frames that the registered queries work on, bound from the shared tables, and the same frames as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["store", "product"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_sales(spark: SparkSession, sf_dir: str, stores: int = 5, parts: int = 100) -> DataFrame:
    """Sales per store, product and week (Monday): only weeks with sales. A product is a range of ``parts`` part keys, so that the
    number of series grows with the tables and a series' weekly demand doesn't."""
    lines = read(spark, sf_dir, "lineitem")
    week = F.to_date(F.date_trunc("week", "l_shipdate"))
    keys = [(F.col("l_suppkey") % stores).cast("int").alias("store"), F.expr(f"cast((l_partkey - 1) div {parts} as int)").alias("product"), week.alias("week")]
    return lines.groupBy(*keys).agg(F.sum("l_quantity").alias("demand"))


def demand_panel(spark: SparkSession, sf_dir: str, stores: int = 5, parts: int = 100) -> DataFrame:
    """store, product, week, week_idx, demand, in_stock: every series in every week, zeros where nothing sold."""
    sales = weekly_sales(spark, sf_dir, stores, parts)
    bounds = sales.agg(F.min("week").alias("first"), F.max("week").alias("last"))
    weeks = bounds.select("first", F.explode(F.sequence("first", "last", F.expr("interval 7 days"))).alias("week"))
    weeks = weeks.select("week", (F.datediff("week", "first") / 7).cast("int").alias("week_idx"))
    panel = sales.select(*KEYS).distinct().crossJoin(F.broadcast(weeks)).join(sales, [*KEYS, "week"], "left")  # a calendar: some hundred rows
    in_stock = F.pmod(F.col("store") * 31 + F.col("product") * 17 + F.col("week_idx") * 7, F.lit(11)) != 0
    return panel.select(*KEYS, "week", "week_idx", F.coalesce("demand", F.lit(0.0)).alias("demand"), in_stock.alias("in_stock"))


def state(panel: DataFrame) -> DataFrame:
    """Stock on hand and two shipments on the way, per series."""
    s, p = F.col("store"), F.col("product")
    return panel.select(*KEYS).distinct().select(*KEYS, *((F.pmod(e, F.lit(m)).cast("double")).alias(n) for n, e, m in (("on_hand", 7 * s + 3 * p, 60), ("intransit_1", s + p, 40), ("intransit_2", 2 * s + p, 40))))


def given_orders(panel: DataFrame) -> DataFrame:
    """A recorded order for each series and week."""
    return panel.select(*KEYS, "week_idx", F.pmod(F.col("store") * 5 + F.col("product") * 3 + F.col("week_idx") * 11, F.lit(25)).cast("double").alias("order_qty"))


PANEL_SQL = """
sales AS (SELECT CAST(l_suppkey % 5 AS INTEGER) store, CAST((l_partkey - 1) // 100 AS INTEGER) product, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS demand FROM lineitem GROUP BY ALL),
weeks AS (SELECT CAST(unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week, min(week) AS first_week FROM sales),
panel AS (SELECT k.store, k.product, w.week, CAST(date_diff('day', w.first_week, w.week) // 7 AS INTEGER) AS week_idx, coalesce(s.demand, 0.0) AS demand,
  (k.store * 31 + k.product * 17 + (date_diff('day', w.first_week, w.week) // 7) * 7) % 11 <> 0 AS in_stock
  FROM (SELECT DISTINCT store, product FROM sales) k CROSS JOIN weeks w LEFT JOIN sales s ON s.store = k.store AND s.product = k.product AND s.week = w.week),
state AS (SELECT DISTINCT store, product, CAST((7 * store + 3 * product) % 60 AS DOUBLE) on_hand, CAST((store + product) % 40 AS DOUBLE) intransit_1, CAST((2 * store + product) % 40 AS DOUBLE) intransit_2 FROM sales),
orders_given AS (SELECT store, product, week_idx, CAST((store * 5 + product * 3 + week_idx * 11) % 25 AS DOUBLE) order_qty FROM panel)"""
