"""Temporal splits: folds as rows, joined to weeks by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["store", "product"]


def rolling_origin(panel: DataFrame, folds: int = 12, horizon: int = 3, least: int = 52) -> DataFrame:
    """Rows with fold_idx, role (train or test), step and ahead (0 for the last training row, step in the test): fold k trains on all but the last folds - k + horizon - 1 rows and tests on
    the next ``horizon``; folds with fewer than ``least`` training rows are left out."""
    by = Window.partitionBy(*KEYS)
    rows = panel.select("*", F.row_number().over(by.orderBy("week_idx")).alias("rn"), F.count("*").over(by).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold_idx"))
    cut = F.col("n") - (folds - F.col("fold_idx")) - horizon + 1
    role = F.when(F.col("rn") <= cut, "train").when(F.col("rn") <= cut + horizon, "test")
    step = F.when(F.col("rn") > cut, F.col("rn") - cut).cast("int")
    return rows.select(*panel.columns, "fold_idx", role.alias("role"), step.alias("step"), (F.col("rn") - cut).cast("int").alias("ahead")).where(F.col("role").isNotNull() & (cut >= least))


def chronological(panel: DataFrame, test_weeks: int = 18, validation: float = 0.1) -> DataFrame:
    """The last weeks of the calendar for test, a tenth of those before for validation, by global cut-offs."""
    weeks = panel.select("week_idx").distinct().agg(F.max("week_idx").alias("last"), F.count("*").alias("n"))
    cuts = weeks.select((F.col("last") - test_weeks).alias("test_after"), (F.col("last") - test_weeks - F.floor((F.col("n") - test_weeks) * validation)).alias("val_after"))
    part = F.when(F.col("week_idx") > F.col("test_after"), "test").when(F.col("week_idx") > F.col("val_after"), "val").otherwise("train")
    return panel.crossJoin(F.broadcast(cuts)).select(*panel.columns, part.alias("part"))  # one row


def blocks_from_end(panel: DataFrame, folds: int = 8, block: int = 3) -> DataFrame:
    """Fold 0 tests on the last ``block`` weeks, fold 1 on those before, and so on; all weeks before a block train."""
    last = panel.agg(F.max("week_idx").alias("last"))
    rows = panel.crossJoin(F.broadcast(last)).select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    end = F.col("last") - F.col("fold") * block
    part = F.when(F.col("week_idx") <= end - block, "train").when(F.col("week_idx") <= end, "test")
    return rows.select(*panel.columns, "fold", part.alias("part")).where(F.col("part").isNotNull())


def competition(panel: DataFrame, weeks: int = 8) -> DataFrame:
    """Test on the last weeks, stop early on the same weeks a year before, train on the weeks before those and between."""
    last = panel.agg(F.max("week").alias("last"))
    rows = panel.crossJoin(F.broadcast(last))
    start = F.date_sub("last", 7 * (weeks - 1))
    part = F.when(F.col("week") >= start, "test").when(F.col("week").between(F.date_sub(start, 364), F.date_sub("last", 364)), "early_stop").otherwise("train")
    return rows.select(*panel.columns, part.alias("part"))
