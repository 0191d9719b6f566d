"""Costs of forecasts, their calibration and correction, and choices between models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inventory


def degenerate(rows: DataFrame, keys: list[str], steps: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Whether the quantiles of any of the steps are all one value."""
    flat = rows.where(F.col("step").isin(*steps)).groupBy(*keys, "step").agg((F.max("value") - F.min("value") < 1e-6).alias("flat"))
    return flat.groupBy(*keys).agg(F.bool_or("flat").alias("degenerate"))


def conformal_adjustments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and tau, the residual y - value of rank ceil((n + 1) tau), within 1 to n. Equal residuals are counted before they are ordered."""
    own = Window.partitionBy(*keys, "tau")
    counts = rows.groupBy(*keys, "tau", F.round(F.col("y") - F.col("value"), 6).alias("adjustment")).count()
    n = F.sum("count").over(own)
    rank = F.greatest(F.lit(1), F.least(n, F.ceil(F.round((n + 1) * F.col("tau"), 9))))
    reached = counts.withColumn("reached", F.sum("count").over(own.orderBy("adjustment")) >= rank)
    return reached.where("reached").groupBy(*keys, "tau").agg(F.min("adjustment").alias("adjustment"))


def calibrated(rows: DataFrame, adjustments: DataFrame, keys: list[str], forecast: list[str]) -> DataFrame:
    """Values with their adjustments, 0 at least, rising with tau within a forecast."""
    moved = F.greatest(F.lit(0.0), F.col("value") + F.coalesce("adjustment", F.lit(0.0)))
    rows = rows.join(adjustments, [*keys, "tau"], "left").withColumn("value", moved)
    return rows.withColumn("value", F.max("value").over(Window.partitionBy(*forecast).orderBy("tau"))).drop("adjustment")


def bias_corrected(rows: DataFrame, factors: DataFrame, key: str, forecast: list[str]) -> DataFrame:
    """Forecasts (tau, value) times ``multiplier``, ``floor`` at least, stretched around their median by ``spread``, 0 at least and
    sorted; those without a row of ``factors`` stay."""
    arrays = rows.groupBy(*forecast).agg(F.array_sort(F.collect_list(F.struct("tau", "value"))).alias("r")).join(factors, key, "left")
    values = F.transform("r", lambda r: r["value"])
    scaled = F.array_sort(F.transform(values, lambda v: F.greatest(v * F.col("multiplier"), F.col("floor"))))
    middle = (F.element_at("v", F.floor((F.size("v") + 1) / 2).cast("int")) + F.element_at("v", F.floor(F.size("v") / 2 + 1).cast("int"))) / 2
    arrays = arrays.withColumn("v", scaled).withColumn("m", middle)
    spread = F.array_sort(F.transform("v", lambda v: F.greatest(F.lit(0.0), F.col("m") + (v - F.col("m")) * F.col("spread"))))
    final = F.when(F.col("multiplier").isNull(), values).otherwise(spread)
    pairs = F.explode(F.arrays_zip(F.transform("r", lambda r: r["tau"]).alias("tau"), final.alias("value"))).alias("q")
    return arrays.select(*forecast, pairs).select(*forecast, "q.tau", "q.value")


def second_week(pmf: DataFrame, state: DataFrame, keys: list[str], state_keys: list[str], under: float = inventory.SHORTAGE, over: float = inventory.HOLDING) -> DataFrame:
    """Order that minimises the expected cost of the second week, and that cost, from distributions (step, x, p) and the stock and
    shipments of ``state``: what the first week leaves and the second shipment meet the second week's demand."""
    first = pmf.where("step = 1").join(state, state_keys)
    left = F.greatest(F.col("on_hand").cast("int") + F.col("intransit_1").cast("int") - F.col("x"), F.lit(0)) + F.col("intransit_2").cast("int")
    stock = first.groupBy(*keys, left.alias("x")).agg(F.sum("p").alias("p"))
    net = inventory.convolve(pmf.where("step = 2"), stock, keys, F.col("xa") - F.col("xb"))
    own, x, p = Window.partitionBy(*keys), F.col("x"), F.col("p")
    upto = own.orderBy("x")
    below, part = F.sum("p").over(upto), F.sum(x * p).over(upto)
    cost = over * (x * below - part) + under * (F.sum(x * p).over(own) - part - x * (F.sum("p").over(own) - below))
    none = F.sum(p * (over * F.greatest(-x, F.lit(0)) + under * F.greatest(x, F.lit(0)))).over(own)
    reached = net.select(*keys, "x", below.alias("cdf"), cost.alias("cost"), none.alias("none")).where(F.col("cdf") >= under / (under + over) - 1e-9)
    best = reached.groupBy(*keys).agg(F.min(F.struct("x", "cost", "none")).alias("b"))
    return best.select(*keys, F.greatest(F.col("b.x"), F.lit(0)).cast("int").alias("order_qty"), F.when(F.col("b.x") < 0, F.col("b.none")).otherwise(F.col("b.cost")).alias("expected_cost"))


def _whole(quantiles: list[dict]) -> np.ndarray:
    """A forecast's probabilities of 0, 1 and so on, as ``inventory.quantiles_to_pmf`` gives them."""
    v = np.maximum.accumulate([max(0.0, q["value"] or 0.0) for q in quantiles])
    t, v = np.array([0.0, *(q["tau"] for q in quantiles), 1.0, 1.0]), np.concatenate([[0.0], v, [v[-1], v[-1] + 1]])
    x = np.arange(int(np.ceil(v[-2])) + 1)
    i = np.searchsorted(v, x, side="right") - 1
    p = np.maximum(np.diff(t[i] + (t[i + 1] - t[i]) * (x - v[i]) / (v[i + 1] - v[i]), prepend=0.0), 0.0)
    return p / p.sum()


def second_week_orders(rows: DataFrame, state: DataFrame, keys: list[str], state_keys: list[str], under: float = inventory.SHORTAGE, over: float = inventory.HOLDING) -> DataFrame:
    """``second_week`` of forecasts' quantiles (step, tau, value). Both steps of a key are one row, and their distributions live in that row only:
    as rows of their own, a task would hold all pairs of numbers of all its keys."""
    each = lambda s: F.array_sort(F.collect_list(F.when(F.col("step") == s, F.struct("tau", "value")))).alias(f"q{s}")
    both = rows.where("step <= 2").groupBy(*keys).agg(each(1), each(2)).where("size(q1) > 0 and size(q2) > 0").join(state, state_keys)
    stock = [F.col(c).cast("int").alias(c) for c in ("on_hand", "intransit_1", "intransit_2")]
    kinds = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys)

    def best(first: np.ndarray, second: np.ndarray, on_hand: int, soon: int, later: int) -> tuple[int, float]:
        left = np.bincount(np.maximum(on_hand + soon - np.arange(len(first)), 0) + later, first)
        p, x = np.convolve(second, left[::-1]), np.arange(len(second) + len(left) - 1) - (len(left) - 1)
        order = max(0, int(x[np.argmax(np.cumsum(p) >= under / (under + over) - 1e-9)]))
        return order, float((p * (over * np.maximum(order - x, 0) + under * np.maximum(x - order, 0))).sum())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("q1", "q2", "on_hand", "intransit_1", "intransit_2")}
            out = [best(_whole(q1), _whole(q2), *s) for q1, q2, *s in zip(*c.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([o for o, _ in out], pa.int32()), pa.array([e for _, e in out], pa.float64())], [*keys, "order_qty", "expected_cost"])

    return both.select(*keys, "q1", "q2", *stock).mapInArrow(solve, f"{kinds}, order_qty int, expected_cost double")


def realised(rows: DataFrame, order: Column, under: float = inventory.SHORTAGE, over: float = inventory.HOLDING) -> DataFrame:
    """holding_cost and shortage_cost of the second week for rows with on_hand, intransit_1, intransit_2, y1 and y2."""
    at = F.greatest(F.col("on_hand") + F.col("intransit_1") - F.bround("y1"), F.lit(0.0)) + F.col("intransit_2") + order
    return rows.withColumn("holding_cost", over * F.greatest(at - F.bround("y2"), F.lit(0.0))).withColumn("shortage_cost", under * F.greatest(F.bround("y2") - at, F.lit(0.0)))


def pooled_order(curves: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """The order that minimises the models' weighted mean cost, over the orders for which all of them have a cost."""
    weighted = curves.join(weights, "model").groupBy(*keys, "q").agg(F.sum(F.col("cost") * F.col("weight")).alias("cost"), F.count("*").alias("n"))
    models = curves.groupBy(*keys).agg(F.count_distinct("model").alias("n"))
    return weighted.join(models, [*keys, "n"]).groupBy(*keys).agg(F.min_by("q", F.struct(F.round("cost", 9), "q")).alias("order_qty"), F.min("cost").alias("cost"))


def cheapest(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The model of the least mean metric for each key, ties to the first by name."""
    means = rows.groupBy(*keys, "model").agg(F.avg(metric).alias("c"))
    return means.groupBy(*keys).agg(F.min_by("model", F.struct(F.round("c", 9), "model")).alias("pick"), F.min("c").alias("c"))


def seasonal_strength(panel: DataFrame, keys: list[str], half: int = 26) -> DataFrame:
    """1 - Var(remainder) / Var(seasonal + remainder) of a classical decomposition: centred moving average, then ISO week means; 0 at least."""
    window = Window.partitionBy(*keys).orderBy("week_idx").rowsBetween(-half, half)
    rows = panel.select(*keys, F.weekofyear("week").alias("iso"), (F.col("demand") - F.avg("demand").over(window)).alias("d"), F.count("*").over(window).alias("n")).where(F.col("n") == 2 * half + 1)
    rows = rows.withColumn("r", F.col("d") - F.avg("d").over(Window.partitionBy(*keys, "iso")))
    return rows.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - F.var_pop("r") / F.var_pop("d")).alias("strength"))


def problems(costs: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows (expected_cost, realised_cost, holding_cost, shortage_cost) that cost most beyond expectation, by severity, with typed labels."""
    expected, real = F.col("expected_cost"), F.col("realised_cost")
    rows = costs.withColumn("cost_ratio", real / F.greatest(expected, F.lit(0.01))).withColumn("severity", (real - expected) * F.log1p(real))
    kinds = {"ZERO_PREDICTION": (expected < 0.01) & (real > 1), "MASSIVE_UNDERESTIMATE": F.col("cost_ratio") > 5, "HIGH_COST": real > 20, "PURE_SHORTAGE": (F.col("shortage_cost") > 0) & (F.col("holding_cost") == 0)}
    label = F.concat_ws(",", *(F.when(c, n) for n, c in kinds.items()))
    rows = rows.withColumn("problem", F.when(label == "", "MODERATE_ERROR").otherwise(label)).where(real > expected)
    return rows.orderBy(F.desc(F.round("severity", 6)), *(c for c in costs.columns if c in ("store", "product", "fold_idx"))).limit(most)
