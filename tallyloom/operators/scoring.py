"""Scores of quantile forecasts (tau, value) against outcomes (y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pinball(tau: Column, value: Column, y: Column) -> Column:
    return F.greatest(tau * (y - value), (tau - 1) * (y - value))


def at_level(level: float, tau: str = "tau", value: str = "value") -> Column:
    """The value at the level nearest to ``level``, the lower of two as near."""
    return F.min_by(value, F.struct(F.round(F.abs(F.col(tau) - level), 9), F.col(tau)))


def per_forecast(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per forecast: the outcome, mean pinball, coverage and width of the 80 and 90 per cent intervals, CRPS by trapezoids, error of the median."""
    over = Window.partitionBy(*keys).orderBy("tau")
    loss = pinball(F.col("tau"), F.col("value"), F.col("y"))
    rows = rows.select("*", loss.alias("loss"), F.lead("tau").over(over).alias("tau2"), F.lead(loss).over(over).alias("loss2"))
    low, high = {80: 0.1, 90: 0.05}, {80: 0.9, 90: 0.95}
    out = [F.avg("loss").alias("pinball"), F.sum((F.col("loss") + F.col("loss2")) * (F.col("tau2") - F.col("tau"))).alias("crps"), (F.first("y") - at_level(0.5)).alias("error"), F.first("y").alias("y")]
    for p in (80, 90):
        out.append((at_level(high[p]) - at_level(low[p])).alias(f"width_{p}"))
        out.append(F.first("y").between(at_level(low[p]), at_level(high[p])).cast("int").alias(f"covered_{p}"))
    return rows.groupBy(*keys).agg(*out)


def pit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The outcome's place in each forecast's distribution function, interpolated between levels and held beyond the ends."""
    over = Window.partitionBy(*keys).orderBy("tau")
    rows = rows.select("*", F.lead("tau").over(over).alias("t2"), F.lead("value").over(over).alias("v2"))
    inside = (F.col("y") >= F.col("value")) & (F.col("y") < F.col("v2"))
    place = F.col("tau") + (F.col("t2") - F.col("tau")) * (F.col("y") - F.col("value")) / (F.col("v2") - F.col("value"))
    below, above = F.min_by("value", "tau"), F.max_by("value", "tau")
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(inside, place)), F.when(F.first("y") < below, F.min("tau")).when(F.first("y") >= above, F.max("tau"))).alias("pit"))


def distance_to_uniform(rows: DataFrame, group: list[str], value: str = "pit", parts: int = 1000) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values (0 to 1) of each group to the uniform distribution.

    Equal values are counted first; ranks are running counts within ``parts`` ranges of values, above the counts of the ranges before, so no task orders a whole group.
    """
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_c")).withColumn("_part", F.floor(F.col(value) * parts))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_m").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy(*group, "_part").agg(F.sum("_c").alias("_m")).select(*group, "_part", before.alias("_before"), F.sum("_m").over(own).alias("n"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group, "_part").orderBy(value))
    gap = F.greatest(upto / F.col("n") - F.col(value), F.col(value) - (upto - F.col("_c")) / F.col("n"))
    placed = counts.join(F.broadcast(ranges), [*group, "_part"])  # at most ``parts`` rows a group
    return placed.select(*group, "n", gap.alias("gap")).groupBy(*group).agg(F.max("gap").alias("ks"), F.first("n").alias("n"))
