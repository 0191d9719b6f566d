"""Readers and writers of weekly retail files: wide sales, flags, states, quantile tables, scenarios, submissions, leaderboards."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["store", "product"]


def normalised(df: DataFrame) -> DataFrame:
    """Lower-case column names with single underscores for anything else but letters and digits."""
    return df.toDF(*(re.sub(r"[^0-9a-z]+", "_", c.strip().lower()).strip("_") for c in df.columns))


def normalised_keys(df: DataFrame) -> DataFrame:
    """Keys read from text as whole numbers."""
    return df.select(*(F.col(k).cast("int").alias(k) for k in KEYS), *(F.col(f"`{c}`") for c in df.columns if c not in KEYS))


def wide_to_long(wide: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per key and week from one column per week; what isn't a whole number counts as 0."""
    weeks = [c for c in wide.columns if re.fullmatch(r"\d{4}-\d\d-\d\d", c)]
    long = wide.select(*keys, *(F.col(f"`{c}`").cast("string").alias(c) for c in weeks)).unpivot(keys, weeks, "week", "value")
    return long.select(*keys, F.to_date("week").alias("week"), F.coalesce(F.expr("try_cast(value AS DOUBLE)"), F.lit(0.0)).alias("demand"))


def long_to_wide(panel: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return panel.withColumn("week", F.date_format("week", "yyyy-MM-dd")).groupBy(*keys).pivot("week").agg(F.first("demand"))


def with_files(history: DataFrame, *more: DataFrame) -> DataFrame:
    """History and later weekly files; the latest file that has a key and week holds."""
    parts = [d.withColumn("_file", F.lit(i)) for i, d in enumerate((history, *more))]
    rows = reduce(DataFrame.unionByName, parts)
    newest = F.row_number().over(Window.partitionBy(*KEYS, "week").orderBy(F.desc("_file")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "_file")


def with_flags(sales: DataFrame, flags: DataFrame) -> DataFrame:
    """Sales with in_stock; a missing flag means in stock."""
    return sales.join(flags.select(*KEYS, "week", "in_stock"), [*KEYS, "week"], "left").withColumn("in_stock", F.coalesce("in_stock", F.lit(True)))


def aligned(template: DataFrame, rows: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Every key of the template in its order (ord), each column from the first of its sources that is there, else 0."""
    picked = [F.coalesce(*(F.col(s).cast("double") for s in sources), F.lit(0.0)).alias(c) for c, sources in columns.items()]
    return template.join(rows, KEYS, "left").select("ord", *KEYS, *picked)


def snapshot(sales: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that each decision may see: weeks before its date."""
    return decisions.join(sales, sales["week"] < decisions["decision_date"])


def leak_audit(snapshots: DataFrame) -> DataFrame:
    """Per decision, its rows, the latest week and the rows dated on or after it."""
    late = (F.col("week") >= F.col("decision_date")).cast("int")
    return snapshots.groupBy("decision_date").agg(F.count("*").alias("n_rows"), F.max("week").alias("last_week"), F.sum(late).alias("n_leaks"))


def save_quantiles(forecast: DataFrame, path: str) -> None:
    """step-partitioned Parquet with a column q_<level> for each level."""
    name = F.concat(F.lit("q_"), F.col("tau").cast("string"))
    keys = [c for c in forecast.columns if c not in ("tau", "value")]
    forecast.withColumn("name", name).groupBy(*keys).pivot("name").agg(F.first("value")).write.mode("overwrite").partitionBy("step").parquet(path)


def load_quantiles(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.parquet(path)
    levels = [c for c in wide.columns if c.startswith("q_")]
    keys = [c for c in wide.columns if c not in levels]
    return wide.unpivot(keys, [F.col(f"`{c}`").alias(c) for c in levels], "name", "value").select(*keys, F.expr("CAST(substring(name, 3) AS DOUBLE)").alias("tau"), "value").where("value is not null")


def submission(template: DataFrame, orders: DataFrame) -> DataFrame:
    """The template's keys in order with whole orders; none means 0."""
    return template.join(orders, KEYS, "left").select("ord", *KEYS, F.coalesce(F.bround("order_qty"), F.lit(0.0)).cast("int").alias("order_qty"))


def validate_submission(template: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counts: rows, nulls, negatives, keys missing and keys unknown."""
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("order_qty").isNull()).alias("n_null"), F.count_if(F.col("order_qty") < 0).alias("n_negative"))
    missing = template.join(rows, KEYS, "left_anti").agg(F.count("*").alias("n_missing"))
    unknown = rows.join(template, KEYS, "left_anti").agg(F.count("*").alias("n_unknown"))
    return counts.crossJoin(missing).crossJoin(unknown)  # one row each


def write_scenarios_xml(scenarios: DataFrame, path: str, root: str = "SLURP") -> None:
    """One element per variable: name, count, mean and median as attributes, the values as text."""
    rows = scenarios.groupBy("name").agg(F.count("*").alias("_count"), F.avg("value").alias("_average"), F.percentile("value", F.lit(0.5)).alias("_median"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scenario_id", "value"))), lambda x: x["value"].cast("string")), ",").alias("_VALUE"))
    rows.withColumnRenamed("name", "_name").write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", "SIP").save(path)


def parse_leaderboard(text: DataFrame, column: str = "text") -> DataFrame:
    """Records of three lines (rank; name; tab-separated applies, order cost, cumulative cost, entries, last seen) from whole texts."""
    pattern = r"(?m)^(\d+)\n([^\n]+)\n(\d+)\t([0-9.,]+)\t([0-9.,]+)\t(\d+)\t([^\n]*)$"
    part = lambda i: F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(i))
    names = ["rank", "name", "apply_count", "order_cost", "cumulative_cost", "entries", "last_seen"]
    rows = text.select("*", F.explode(F.arrays_zip(*(part(i + 1).alias(n) for i, n in enumerate(names)))).alias("r"))
    number = lambda n: F.regexp_replace(F.col(f"r.{n}"), ",", "")
    kinds: dict[str, Column] = {n: number(n).cast("int") for n in ("rank", "apply_count", "entries")} | {n: number(n).cast("double") for n in ("order_cost", "cumulative_cost")}
    return rows.select(*(c for c in text.columns if c != column), *(kinds.get(n, F.col(f"r.{n}")).alias(n) for n in names))
