"""Descriptive statistics and tests as aggregates over (keys, index, value) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Moments, quartiles, variation, dispersion of quartiles, median absolute deviation, range, zeros."""
    q = lambda p: F.percentile(value, F.lit(p))
    median = df.groupBy(*keys).agg(q(0.5).alias("_median"))
    rows = df.join(median, keys)
    v = F.col(value)
    out = {
        "mean": F.avg(v), "sd": F.stddev_pop(value), "cv": F.try_divide(F.stddev_pop(value), F.avg(v)), "q25": q(0.25), "median": q(0.5), "q75": q(0.75), "iqr": q(0.75) - q(0.25),
        "qcd": F.try_divide(q(0.75) - q(0.25), q(0.75) + q(0.25)), "mad": F.percentile(F.abs(v - F.col("_median")), F.lit(0.5)), "range": F.max(v) - F.min(v),
        "skew": F.skewness(value), "kurtosis": F.kurtosis(value), "zero_share": F.avg((v == 0).cast("double")),
    }
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items()))


def autocorrelations(df: DataFrame, keys: list[str], index: str, value: str, lags: int = 12) -> DataFrame:
    """keys, n, acf: an array over lags 1..lags; null beyond the series and where nothing varies. A group is a series: its rows are the calendar's."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(table: pa.Table) -> pa.Table:
        y = table[value].to_numpy()[np.argsort(table[index].to_numpy(), kind="stable")].astype(float)
        d = np.nan_to_num(y - np.nanmean(y)) if not np.isnan(y).all() else np.zeros(len(y))
        ss = d @ d
        acf = [float(d[k:] @ d[:-k] / ss) if ss > 0 and k < len(d) else None for k in range(1, lags + 1)]
        return pa.table({k: table[k].slice(0, 1) for k in keys} | {"n": pa.array([len(y)], pa.int64()), "acf": pa.array([acf], pa.list_(pa.float64()))})

    return df.select(*keys, index, F.col(value).cast("double").alias(value)).groupBy(*keys).applyInArrow(one, f"{kinds}, n long, acf array<double>")


def autocorrelation(df: DataFrame, keys: list[str], index: str, value: str, lags: int = 12) -> DataFrame:
    """Autocorrelation at lags 1..lags per key, with n."""
    rows = autocorrelations(df, keys, index, value, lags).select(*keys, "n", F.posexplode("acf").alias("i", "acf"))
    return rows.select(*keys, (F.col("i") + 1).alias("lag"), "n", "acf")


def ljung_box(acf: DataFrame, keys: list[str], upto: int) -> DataFrame:
    n = F.col("n")
    return acf.where(F.col("lag") <= upto).groupBy(*keys).agg(F.sum(n * (n + 2) * F.col("acf") ** 2 / (n - F.col("lag"))).alias("q"))


def power_law(df: DataFrame, keys: list[str], index: str, value: str, block: int = 13) -> DataFrame:
    """Slope and fit of ln variance on ln mean over blocks of weeks."""
    blocks = df.groupBy(*keys, F.floor(F.col(index) / block).alias("b")).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("m > 0 and v > 0")
    return blocks.groupBy(*keys).agg(F.regr_slope(F.ln("v"), F.ln("m")).alias("slope"), F.regr_r2(F.ln("v"), F.ln("m")).alias("r2"))


def cusum(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Largest excursion of the running sum of deviations, in deviations times the root of n; a break beyond 1.358."""
    own = Window.partitionBy(*keys)
    rows = df.select(*keys, index, (F.col(value) - F.avg(value).over(own)).alias("d"), F.stddev_pop(value).over(own).alias("sd"), F.count("*").over(own).alias("n"))
    run = F.abs(F.sum("d").over(own.orderBy(index))) / (F.col("sd") * F.sqrt("n"))
    return rows.select(*keys, run.alias("s")).groupBy(*keys).agg(F.max("s").alias("stat"), (F.max("s") > 1.358).alias("breaks"))


def periodogram(df: DataFrame, keys: list[str], index: str, value: str, periods: list[int]) -> DataFrame:
    """Power at whole periods: squared sums against cosines and sines, added in the order of the index. A key's values are one array (as long as the
    calendar); periods multiply it in place, after the shuffle by key."""
    values = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    own = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(values.alias("values"), F.avg(value).alias("mean"))
    centred = F.transform("values", lambda x: F.struct((x["i"] * (2 * 3.141592653589793)).alias("turn"), (x["v"] - F.col("mean")).alias("d")))
    rows = own.select(*keys, centred.alias("own")).select(*keys, "own", F.explode(F.array(*map(F.lit, periods))).alias("period"))
    part = lambda f: F.aggregate("own", F.lit(0.0), lambda s, x: s + x["d"] * f(x["turn"] / F.col("period")))
    return rows.select(*keys, "period", (part(F.cos) ** 2 + part(F.sin) ** 2).alias("power"))


def entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def mutual_information(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mutual information of two discrete columns per key, from the contingency table."""
    cells = df.groupBy(*keys, x, y).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keys)
    n, nx, ny = F.sum("c").over(own), F.sum("c").over(Window.partitionBy(*keys, x)), F.sum("c").over(Window.partitionBy(*keys, y))
    term = F.col("c") / n * F.ln(F.col("c") * n / (nx * ny))
    return cells.select(*keys, term.alias("t")).groupBy(*keys).agg(F.sum("t").alias("mi"))


def average_rank(value: str, over: list[str]) -> Column:
    """Ranks with ties averaged."""
    w = Window.partitionBy(*over).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*over, value)) - 1) / 2.0
