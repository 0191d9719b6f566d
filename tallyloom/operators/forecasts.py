"""Forecasters: a panel of training rows to quantile rows (store, product, fold_idx, step, tau, value), all series and folds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["store", "product", "fold_idx"]
LEVELS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
#: Standard normal quantiles of LEVELS, to 6 decimals.
Z = [-2.326348, -1.644854, -1.281552, -0.841621, -0.524401, -0.253347, 0.0, 0.253347, 0.524401, 0.841621, 1.281552, 1.644854, 2.326348]
STEPS = 3


def _levels(values: Column) -> Column:
    """(tau, value) rows from an array in the order of LEVELS."""
    return F.explode(F.arrays_zip(F.array(*map(F.lit, LEVELS)).alias("tau"), values.alias("value"))).alias("q")


def _steps() -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")


def placed(train: DataFrame) -> DataFrame:
    """Training rows with ahead (0 for a fold's last) and year_ago. Both are best worked out before folds multiply the rows; here, where they are missing."""
    own = Window.partitionBy(*KEYS)
    rows = train if "ahead" in train.columns else train.withColumn("ahead", (F.row_number().over(own.orderBy("week_idx")) - F.count("*").over(own)).cast("int"))
    return rows if "year_ago" in rows.columns else rows.withColumn("year_ago", F.lag("demand", 52).over(own.orderBy("week_idx")))


def seasonal_naive(train: DataFrame) -> DataFrame:
    """The value a year before the target plus quantiles of the yearly differences seen in training, 0 at least."""
    rows = placed(train).withColumn("res", F.col("demand") - F.col("year_ago"))
    quantiles = rows.groupBy(*KEYS).agg(F.percentile("res", F.array(*map(F.lit, LEVELS))).alias("r"))
    base = rows.withColumn("step", F.col("ahead") + 52).where(F.col("step").between(1, STEPS)).select(*KEYS, "step", F.col("demand").alias("base"))
    return base.join(quantiles, KEYS).select(*KEYS, "step", "base", _levels(F.col("r"))).select(*KEYS, "step", "q.tau", F.greatest(F.lit(0.0), F.col("base") + F.col("q.value")).alias("value"))


def naive_mean(train: DataFrame, weeks: int = 4) -> DataFrame:
    """The mean of the last weeks with normal quantiles of that level's Poisson variance, 0 at least."""
    rows = placed(train).where(F.col("ahead") > -weeks)
    mean = rows.groupBy(*KEYS).agg(F.avg("demand").alias("mu"))
    normal = F.transform(F.array(*map(F.lit, Z)), lambda z: F.greatest(F.lit(0.0), F.col("mu") + z * F.sqrt("mu")))
    return mean.select(*KEYS, "mu", _steps()).select(*KEYS, "step", _levels(normal)).select(*KEYS, "step", "q.tau", "q.value")


def poisson_quantiles(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Least x with a Poisson distribution function of tau or more, for each rate (``mu``). The x tried end ten deviations above the rate."""
    own = Window.partitionBy(*keys).orderBy("x")
    mu, x = F.greatest(F.col("mu"), F.lit(1e-9)), F.col("x")
    tried = rates.select(*keys, "mu", F.explode(F.sequence(F.lit(0), F.ceil(F.col("mu") + 10 * F.sqrt("mu") + 10).cast("int"))).alias("x"))
    log_p = x * F.ln(mu) - F.col("mu") - F.sum(F.ln(F.greatest(x, F.lit(1)).cast("double"))).over(own)
    cdf = tried.withColumn("p", F.exp(log_p)).withColumn("cdf", F.sum("p").over(own))
    first = cdf.groupBy(*keys).agg(*(F.count_if(F.col("cdf") < t - 1e-12).cast("double").alias(f"v{i}") for i, t in enumerate(LEVELS)))
    return first.select(*keys, _levels(F.array(*(F.col(f"v{i}") for i in range(len(LEVELS)))))).select(*keys, "q.tau", "q.value")


def croston(train: DataFrame, alpha: float = 0.1, corrected: bool = True) -> DataFrame:
    """Level per series and fold by exponential smoothing of sizes and of gaps between sales (corrected for its bias by 1 - alpha / 2)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("week_idx", "demand"))), lambda r: r["demand"])
    start = F.struct(F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("gap"), F.lit(1.0).alias("since"))

    def step(a: Column, y: Column) -> Column:
        sold = y > 0
        size = F.when(sold, F.coalesce(a.size + alpha * (y - a.size), y)).otherwise(a.size)
        gap = F.when(sold, F.coalesce(a.gap + alpha * (a.since - a.gap), a.since)).otherwise(a.gap)
        return F.struct(size.alias("size"), gap.alias("gap"), F.when(sold, 1.0).otherwise(a.since + 1).alias("since"))

    state = train.groupBy(*KEYS).agg(F.aggregate(values, start, step).alias("s"))
    return state.select(*KEYS, F.coalesce(F.col("s.size") / F.col("s.gap") * ((1 - alpha / 2) if corrected else 1.0), F.lit(0.0)).alias("level"))


def smoothed_level(train: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Simple exponential smoothing by one ordered fold per series and fold, with the one-step error's variance."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("week_idx", "demand"))), lambda r: r["demand"])
    start = F.struct(F.lit(None).cast("double").alias("l"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"))

    def step(a: Column, y: Column) -> Column:
        e = y - F.coalesce(a.l, y)
        return F.struct((F.coalesce(a.l, y) + alpha * e).alias("l"), (a.sse + e * e).alias("sse"), (a.n + 1).alias("n"))

    state = train.groupBy(*KEYS).agg(F.aggregate(values, start, step).alias("s"))
    return state.select(*KEYS, F.col("s.l").alias("level"), (F.col("s.sse") / F.greatest(F.col("s.n") - 1, F.lit(1))).alias("variance"))


def seasonal_index(train: DataFrame, weeks: int = 13) -> DataFrame:
    """Mean forecasts: series' last weeks' mean of values freed of the ISO week's index, times the target week's index."""
    rows = placed(train)
    sums = rows.groupBy("fold_idx", F.weekofyear("week").alias("iso")).agg(F.sum("demand").alias("total"), F.count("demand").alias("n"))
    every = Window.partitionBy("fold_idx")  # at most 53 rows a fold
    index = sums.select("fold_idx", "iso", (F.col("total") / F.col("n") / (F.sum("total").over(every) / F.sum("n").over(every))).alias("factor"))
    rows = rows.where(F.col("ahead") > -weeks).withColumn("iso", F.weekofyear("week")).join(F.broadcast(index), ["fold_idx", "iso"])
    level = rows.groupBy(*KEYS).agg(F.avg(F.col("demand") / F.greatest(F.col("factor"), F.lit(1e-6))).alias("level"), F.max("week").alias("last"))
    ahead = level.select(*KEYS, "level", "last", _steps()).withColumn("iso", F.weekofyear(F.expr("date_add(last, 7 * step)")))
    return ahead.join(F.broadcast(index), ["fold_idx", "iso"]).select(*KEYS, "step", (F.col("level") * F.col("factor")).alias("value"))
