"""Orders and ledgers. A ledger over recorded demand and given orders needs no loop: with c the running balance of stock, arrivals
and demand, stock after week t is c(t) less the least of 0 and the lowest balance so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["store", "product"]
HOLDING, SHORTAGE = 0.2, 1.0


def ledger(panel: DataFrame, state: DataFrame, orders: DataFrame, lead: int = 2, holding: float = HOLDING, shortage: float = SHORTAGE) -> DataFrame:
    """Per series and week: stock at the start, arrivals, sales, shortage, stock left and costs; an order arrives ``lead`` weeks later
    and can be sold in that week."""
    by = Window.partitionBy(*KEYS).orderBy("week_idx")
    rows = panel.select(*KEYS, "week_idx", "demand").join(orders, [*KEYS, "week_idx"], "left").join(state, KEYS)
    first = F.min("week_idx").over(Window.partitionBy(*KEYS))
    planned = F.when(F.col("week_idx") == first, F.col("intransit_1")).when(F.col("week_idx") == first + 1, F.col("intransit_2")).otherwise(0.0)
    rows = rows.withColumn("arriving", planned + F.coalesce(F.lag("order_qty", lead).over(by), F.lit(0.0)))
    rows = rows.withColumn("c", F.col("on_hand") + F.sum(F.col("arriving") - F.col("demand")).over(by))
    rows = rows.withColumn("leftover", F.col("c") - F.least(F.lit(0.0), F.min("c").over(by)))
    rows = rows.withColumn("start", F.coalesce(F.lag("leftover").over(by), F.col("on_hand")))
    sold = F.least(F.col("start") + F.col("arriving"), F.col("demand"))
    rows = rows.withColumn("sold", sold).withColumn("shortage", F.col("demand") - F.col("sold"))
    return rows.select(*KEYS, "week_idx", F.col("start").alias("on_hand_start"), "arriving", "demand", "sold", "shortage", "leftover", (F.col("leftover") * holding).alias("holding_cost"), (F.col("shortage") * shortage).alias("shortage_cost"))


def base_stock(mu: Column, sigma: Column, position: Column, lead: int = 3, z: float = 0.967) -> Column:
    """Order up to lead-time demand and z deviations of it, rounded half to even, 0 at least."""
    return F.greatest(F.lit(0.0), F.bround(mu * lead + z * sigma * (lead**0.5) - position))


def normalised(pmf: DataFrame, keys: list[str]) -> DataFrame:
    p = F.greatest(F.col("p"), F.lit(0.0))
    return pmf.withColumn("p", p / F.sum(p).over(Window.partitionBy(*keys)))


def empirical_pmf(panel: DataFrame, keys: list[str], cap: int | None = None, value: str = "demand") -> DataFrame:
    """p(x) of rounded values; with a cap, those beyond it are put on it."""
    x = F.bround(F.col(value))
    x = (x if cap is None else F.least(x, F.lit(float(cap)))).cast("int")
    counts = panel.groupBy(*keys, x.alias("x")).count()
    return counts.select(*keys, "x", (F.col("count") / F.sum("count").over(Window.partitionBy(*keys))).alias("p"))


def share_above(rows: DataFrame, keys: list[str], level: Column, value: str = "demand") -> DataFrame:
    """above, n: how many of each group's rounded values are above the level, and how many there are."""
    return rows.groupBy(*keys).agg(F.count_if(F.bround(F.col(value)).cast("int") > level).alias("above"), F.count("*").alias("n"))


def convolve(a: DataFrame, b: DataFrame, keys: list[str], combine: Column | None = None) -> DataFrame:
    """Distribution of a function of two independent variables (columns xa and xb; their sum if not given)."""
    pairs = a.select(*keys, F.col("x").alias("xa"), F.col("p").alias("pa")).join(b.select(*keys, F.col("x").alias("xb"), F.col("p").alias("pb")), keys)
    x = (F.col("xa") + F.col("xb")) if combine is None else combine
    return pairs.groupBy(*keys, x.alias("x")).agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))


def leftover(demand: DataFrame, stock: DataFrame, keys: list[str]) -> DataFrame:
    """Stock left by one period's demand: (s - d)+, for a distribution of stock."""
    return convolve(stock, demand, keys, F.greatest(F.col("xa") - F.col("xb"), F.lit(0)))


def fractile(pmf: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Least x whose distribution function reaches the level."""
    cdf = F.sum("p").over(Window.partitionBy(*keys).orderBy("x"))
    return pmf.withColumn("cdf", cdf).where(F.col("cdf") >= level - 1e-9).groupBy(*keys).agg(F.min("x").alias("x"))


def newsvendor_order(demand: DataFrame, stock: DataFrame, keys: list[str], under: float = SHORTAGE, over: float = HOLDING) -> DataFrame:
    """Two periods: what is left after the first meets the second; the order is the critical fractile of second demand less that, 0 at least."""
    left = leftover(demand, stock, keys)
    net = convolve(demand, left, keys, F.col("xa") - F.col("xb"))
    return fractile(net, keys, under / (under + over)).select(*keys, F.greatest(F.col("x"), F.lit(0)).alias("order_qty"))


def cost_curve(net: DataFrame, keys: list[str], under: float = SHORTAGE, over: float = HOLDING) -> DataFrame:
    """Expected cost of each order from 0 to the most that can be missing (x, p), from running sums of p and of x p."""
    grid = net.groupBy(*keys).agg(F.greatest(F.max("x"), F.lit(0)).cast("int").alias("top"))
    every = net.select(*keys, F.col("x").cast("int").alias("x"), "p").unionByName(grid.select(*keys, F.explode(F.sequence(F.lit(0), "top")).alias("x"), F.lit(0.0).alias("p")))
    points = every.groupBy(*keys, "x").agg(F.sum("p").alias("p"))
    own = Window.partitionBy(*keys)
    upto, x, p = own.orderBy("x"), F.col("x"), F.col("p")
    below, part = F.sum("p").over(upto), F.sum(x * p).over(upto)
    cost = over * (x * below - part) + under * (F.sum(x * p).over(own) - part - x * (F.sum("p").over(own) - below))
    return points.select(*keys, x.alias("q"), cost.alias("cost")).where("q >= 0")


def replay(weeks: DataFrame, state: DataFrame, targets: DataFrame, holding: float = HOLDING, shortage: float = SHORTAGE) -> DataFrame:
    """Closed loop: each week's order fills the position up to the series' target (column ``target``), arrives two weeks later, and
    depends on what the orders before it led to. One ordered fold per series and parameter row of ``targets``."""
    params = [c for c in targets.columns if c not in (*KEYS, "target")]
    series = weeks.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("week_idx", "demand"))), lambda r: r["demand"]).alias("ys"))
    rows = series.join(state, KEYS).join(targets, KEYS)
    zero = F.lit(0.0)
    start = F.struct(F.col("on_hand").alias("s"), F.col("intransit_1").alias("a"), F.col("intransit_2").alias("b"), zero.alias("h"), zero.alias("c"), zero.alias("n"))

    def step(x: Column, y: Column) -> Column:
        left = F.greatest(x.s + x.a - y, zero)
        short = F.greatest(y - x.s - x.a, zero)
        order = F.greatest(F.bround(F.col("target") - left - x.b), zero)
        return F.struct(left.alias("s"), x.b.alias("a"), order.alias("b"), (x.h + left * holding).alias("h"), (x.c + short * shortage).alias("c"), (x.n + order).alias("n"))

    return rows.select(*KEYS, *params, F.aggregate("ys", start, step).alias("r")).select(*KEYS, *params, F.col("r.h").alias("holding_cost"), F.col("r.c").alias("shortage_cost"), F.col("r.n").alias("ordered"))


def quantiles_to_pmf(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-number distribution of each forecast: its quantiles (0 at least, rising), with 0 at level 0 and the highest at level 1,
    interpolated as a distribution function on 0..ceil(highest), differenced and made to sum to 1. A forecast's segments are exploded to the numbers in them, without a join."""
    zero = F.lit(0.0)
    point = lambda t, v: F.struct(t.cast("double").alias("t"), v.cast("double").alias("v"))
    sorted_rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tau", "value"))).alias("r"))
    rising = F.transform("r", lambda e, i: point(e["tau"], F.array_max(F.transform(F.slice("r", 1, i + 1), lambda b: F.greatest(zero, b["value"])))))
    arrays = sorted_rows.select(*keys, rising.alias("r")).withColumn("top", F.element_at("r", -1)["v"])
    points = F.concat(F.array(point(zero, zero)), "r", F.array(point(F.lit(1.0), F.col("top")), point(F.lit(1.0), F.col("top") + 1)))
    arrays = arrays.select(*keys, points.alias("pts"))
    pairs = F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))
    segments = arrays.select(*keys, F.explode(pairs).alias("s")).select(*keys, F.col("s.a.t").alias("t"), F.col("s.a.v").alias("v"), F.col("s.b.t").alias("t2"), F.col("s.b.v").alias("v2"))
    segments = segments.withColumn("low", F.ceil("v").cast("int")).withColumn("high", (F.ceil("v2") - 1).cast("int")).where("v2 > v and high >= low")
    at = segments.select("*", F.explode(F.sequence("low", "high")).alias("x"))
    cdf = at.select(*keys, "x", (F.col("t") + (F.col("t2") - F.col("t")) * (F.col("x") - F.col("v")) / (F.col("v2") - F.col("v"))).alias("cdf"))
    p = F.col("cdf") - F.coalesce(F.lag("cdf").over(Window.partitionBy(*keys).orderBy("x")), zero)
    return normalised(cdf.select(*keys, "x", p.alias("p")), keys)
