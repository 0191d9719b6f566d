"""Variance-stabilising transforms and their inverses as native expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-6
FORWARD: dict[str, Callable[[Column], Column]] = {
    "identity": lambda y: y, "log": lambda y: F.ln(F.greatest(y, F.lit(FLOOR))), "log1p": lambda y: F.log1p(F.greatest(y, F.lit(0.0))),
    "sqrt": lambda y: F.sqrt(F.greatest(y, F.lit(0.0))), "cbrt": F.cbrt,
}
#: The same for arrays inside tasks.
NUMPY: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda y: y, "log": lambda y: np.log(np.maximum(y, FLOOR)), "log1p": lambda y: np.log1p(np.maximum(y, 0.0)),
    "sqrt": lambda y: np.sqrt(np.maximum(y, 0.0)), "cbrt": np.cbrt,
}
INVERSE: dict[str, Callable[[Column], Column]] = {"identity": lambda z: z, "log": F.exp, "log1p": F.expm1, "sqrt": lambda z: z * z, "cbrt": lambda z: z * z * z}
NUMPY_INVERSE: dict[str, Callable[[np.ndarray], np.ndarray]] = {"identity": lambda z: z, "log": np.exp, "log1p": np.expm1, "sqrt": np.square, "cbrt": lambda z: z * z * z}


def apply(name: Column, value: Column, table: dict[str, Callable[[Column], Column]]) -> Column:
    """The transform that each row names."""
    out = F.lit(None).cast("double")
    for known, f in table.items():
        out = F.when(name == known, f(value)).otherwise(out)
    return out


def bias_corrected(name: Column, mean: Column, variance: Column) -> Column:
    """The inverse of a mean in the transformed space with the second-order correction for logarithms and roots."""
    return F.when(name.isin("log", "log1p"), apply(name, mean + variance / 2, INVERSE)).when(name == "sqrt", mean * mean + variance).when(name == "cbrt", mean**3 + 3 * mean * variance).otherwise(mean)


def candidates(panel: DataFrame, value: str = "demand") -> DataFrame:
    """One row per row and transform: name, z."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("transform"), f(F.col(value)).alias("z")) for n, f in FORWARD.items()))).alias("t")
    return panel.select("*", named).select(*panel.columns, "t.transform", "t.z")


def best_by_variation(panel: DataFrame, keys: list[str], value: str = "demand") -> DataFrame:
    """Per series, the transform whose values vary least against their mean over positive rows; ties go to the first name."""
    rows = candidates(panel.where(F.col(value) > 0), value)
    cv = (F.stddev_pop("z") / F.abs(F.avg("z"))).alias("cv")
    per = rows.groupBy(*keys, "transform").agg(F.avg("z").alias("m"), cv).where(F.abs("m") > 1e-9)
    return per.groupBy(*keys).agg(F.min_by("transform", F.struct(F.round("cv", 9), "transform")).alias("transform"), F.min("cv").alias("cv"))
