"""Information between columns in quantile bins, its parts, and what it says of features; serial tests from autocovariances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .statistics import mutual_information


def binned(rows: DataFrame, keys: list[str], name: str, value: str, bins: int = 8) -> DataFrame:
    """``rows`` (keys, name, value: long form) with ``bin``: between the different ones of ``bins`` + 1 quantiles of the group's values, the greatest in a bin
    of its own; where fewer than three differ, between as many equal parts of the ranks (ties averaged)."""
    own = [*keys, name]
    edges = rows.groupBy(*own).agg(F.array_distinct(F.transform(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(bins + 1)))), lambda e: F.round(e, 9))).alias("_edges"))
    by = Window.partitionBy(*own)
    rank = F.rank().over(by.orderBy(value)) + (F.count("*").over(Window.partitionBy(*own, value)) - 1) / 2
    placed = rows.withColumn("_rank", rank).withColumn("_most", F.max("_rank").over(by)).join(edges, own)
    few = F.floor(F.col("_rank") / ((F.col("_most") + 1) / bins))
    return placed.withColumn("bin", F.when(F.size("_edges") < 3, few).otherwise(F.size(F.filter("_edges", lambda e: e <= F.col(value))) - 1).cast("int")).drop("_edges", "_rank", "_most")


def _bins(v: np.ndarray, bins: int = 8) -> np.ndarray:
    """The bins of ``binned``, of one group's values."""
    edges = np.unique(np.round(np.quantile(v, np.arange(bins + 1) / bins), 9))
    if len(edges) >= 3:
        return np.searchsorted(edges, v, side="right") - 1
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    return np.floor(rank / ((rank.max() + 1) / bins)).astype(int)


def _bits(x: np.ndarray, y: np.ndarray) -> float:
    c = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    (a, b), n = c[0].T, c[1]
    at = lambda v: np.bincount(np.unique(v, return_inverse=True)[1], n)[np.unique(v, return_inverse=True)[1]]
    return float((n / len(x) * np.log2(n * len(x) / (at(a) * at(b)))).sum())


def told(rows: DataFrame, keys: list[str], y: str, features: list[str], joint: tuple[str, str], least: int = 16) -> DataFrame:
    """keys, feature, mi: bits that each feature's bins tell of those of ``y``, and the two of ``joint`` together (feature: joint). A group is a series, whose
    rows are the calendar's; it is binned and counted in one place, as columns, where long rows would be ranked and joined feature by feature."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def one(table: pa.Table) -> pa.Table:
        if table.num_rows < least:
            features_, mi = [], []
        else:
            b = {c: _bins(table[c].to_numpy()) for c in (y, *features)}
            features_ = [*features, "joint"]
            mi = [*(_bits(b[f], b[y]) for f in features), _bits(b[joint[0]] * 1000 + b[joint[1]], b[y])]
        own = {k: pa.array([table[k][0].as_py()] * len(mi), table.schema.field(k).type) for k in keys}
        return pa.table(own | {"feature": pa.array(features_, pa.string()), "mi": pa.array(mi, pa.float64())})

    return rows.select(*keys, y, *features).groupBy(*keys).applyInArrow(one, f"{kinds}, feature string, mi double")


def bits(rows: DataFrame, keys: list[str], x: str, y: str, name: str) -> DataFrame:
    return mutual_information(rows, keys, x, y).select(*keys, (F.col("mi") / F.ln(F.lit(2.0))).alias(name))


def decomposed(rows: DataFrame, keys: list[str], x1: str, x2: str, y: str) -> DataFrame:
    """keys, mi_x1_y, mi_x2_y, mi_x1x2_y and their parts: redundancy (the lesser), what is each one's own, and what only both together tell."""
    joint = rows.withColumn("_joint", F.struct(x1, x2))
    return parted(bits(rows, keys, x1, y, "mi_x1_y").join(bits(rows, keys, x2, y, "mi_x2_y"), keys).join(bits(joint, keys, "_joint", y, "mi_x1x2_y"), keys))


def parts_told(mi: DataFrame, keys: list[str], x1: str, x2: str) -> DataFrame:
    """The columns of ``decomposed``, from the rows of ``told``."""
    of = lambda f: F.max(F.when(F.col("feature") == f, F.col("mi")))
    return parted(mi.groupBy(*keys).agg(of(x1).alias("mi_x1_y"), of(x2).alias("mi_x2_y"), of("joint").alias("mi_x1x2_y")))


def parted(out: DataFrame) -> DataFrame:
    out = out.withColumn("redundancy", F.least("mi_x1_y", "mi_x2_y"))
    own = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col("redundancy"))
    out = out.withColumns({"unique_x1": own("mi_x1_y"), "unique_x2": own("mi_x2_y")})
    return out.withColumn("synergy", F.greatest(F.lit(0.0), F.col("mi_x1x2_y") - F.col("unique_x1") - F.col("unique_x2") - F.col("redundancy")))


def feature_weights(information: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, mi, rank, weight (0.5 for the least informative of a group to 2.0 for the most) and k (neighbours to use: fewer the more is known)."""
    own = Window.partitionBy(*keys)
    low, high, total = F.min("mi").over(own), F.max("mi").over(own), F.sum("mi").over(own)
    weight = F.when(high == 0, 1.0).otherwise(0.5 + 1.5 * (F.col("mi") - low) / (high - low + 1e-9))
    k = F.least(F.lit(120), F.greatest(F.lit(10), (100 - 60 * total).cast("int")))
    return information.select(*keys, "feature", "mi", F.row_number().over(own.orderBy(F.desc(F.round("mi", 9)), "feature")).alias("rank"), weight.alias("weight"), k.alias("k"))


@F.pandas_udf(ArrayType(DoubleType()))
def partial_autocorrelation(acf: pd.Series) -> pd.Series:
    """Partial autocorrelations at lags 1 to n from the array of autocorrelations at them, by the recursion over orders."""

    def recursion(r: np.ndarray) -> list[float | None]:
        phi, pacf = np.zeros(0), []
        for k in range(len(r)):
            bottom = 1 - phi @ r[:k]
            new = (r[k] - phi @ r[:k][::-1]) / bottom if bottom else np.nan
            phi = np.append(phi - new * phi[::-1], new)
            pacf.append(None if np.isnan(new) else float(new))
        return pacf

    return acf.map(lambda r: recursion(np.asarray(r, float)), na_action="ignore")


def level_stationarity(acf: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat, lags, p_value, stationary: partial sums against a long-run variance whose number of lags comes from the data.

    ``acf``: keys, acf (array over lags); ``sums``: keys, n, ss (squared deviations), cs (squared partial sums). p is read off a table between
    0.1 and 0.01; the lags stop at those of the array.
    """
    n, r = F.col("n"), F.col("acf")
    rows = acf.join(sums, keys).withColumn("_first", F.floor(F.pow(n.cast("double"), F.lit(2 / 9))).cast("int"))
    upto = lambda m: F.sequence(F.lit(1), m)
    s0 = 1 + 2 * F.aggregate(upto(F.col("_first")), F.lit(0.0), lambda s, i: s + F.get(r, i - 1))
    s1 = 2 * F.aggregate(upto(F.col("_first")), F.lit(0.0), lambda s, i: s + i * F.get(r, i - 1))
    rows = rows.withColumn("_gamma", 1.1447 * F.pow(F.pow(s1 / s0, F.lit(2)), F.lit(1 / 3)))
    rows = rows.withColumn("lags", F.least(F.floor(F.col("_gamma") * F.pow(n.cast("double"), F.lit(1 / 3))).cast("int"), (n - 1).cast("int"), F.size(r)))
    long_run = F.col("ss") / n * (1 + 2 * F.when(F.col("lags") > 0, F.aggregate(upto(F.greatest("lags", F.lit(1))), F.lit(0.0), lambda s, i: s + F.get(r, i - 1) * (1 - i / (F.col("lags") + 1)))).otherwise(0.0))
    rows = rows.withColumn("stat", F.col("cs") / (n * n) / long_run)
    # Critical values and their levels.
    table, stat = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)], F.col("stat")
    p = F.when(stat <= 0.347, 0.10)
    for (a, pa), (b, pb) in zip(table, table[1:]):
        p = p.when(stat <= b, pa + (stat - a) * ((pb - pa) / (b - a)))
    p = p.otherwise(0.01)
    return rows.select(*keys, "stat", "lags", p.alias("p_value"), (p > 0.05).alias("stationary"))


def changing_variance(panel: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """keys, lags, lm: observations times the fit of squared deviations on their own values at 1 to min(``most``, n / 4) lags. A group is a series: its rows are the calendar's."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("week_idx").demand.to_numpy()
        out = {k: [rows[k].iloc[0]] for k in keys}
        e, lags = (y - y.mean()) ** 2, min(most, len(y) // 4)
        if lags < 1 or len(y) < 20 or not y.std():
            return pd.DataFrame(out | {"lags": [lags], "lm": [np.nan]})
        x = np.column_stack([np.ones(len(e) - lags), *(e[lags - k : len(e) - k] for k in range(1, lags + 1))])
        target = e[lags:]
        left = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
        total = ((target - target.mean()) ** 2).sum()
        return pd.DataFrame(out | {"lags": [lags], "lm": [len(target) * (1 - (left**2).sum() / total) if total else np.nan]})

    kinds = ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in keys)
    out = panel.select(*keys, "week_idx", "demand").groupBy(*keys).applyInPandas(fit, f"{kinds}, lags int, lm double")
    return out.withColumn("lm", F.nanvl("lm", F.lit(None).cast("double")))
