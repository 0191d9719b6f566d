"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables has ``functions`` projections on normal directions, cut into cells of a common width: a
vector's bucket is the row of its cells. A query visits buckets in the order of their estimated success: if a neighbour
lies at the expected distance r, its projections differ from the query's by normal amounts of that spread, so a bucket's
success is a product of normal areas. Buckets are taken best first until their successes add up to the table's share of
``success`` (the tables together miss with the product of their misses). Candidates of all tables are merged and reranked
by exact distance.

A query that has fewer than ``k`` candidates then, or whose k-th lies beyond r, lies farther from the rest than the sample: it is searched again in tables
of a wider r, ``growth`` times as wide in each of ``rounds``. What is still unfilled after them is compared with all rows, a block of queries at a time.

Only r (nine tenths of the sampled vectors have their nearest in the sample within it) and the width are fitted, on at most ``sample`` vectors (the first by a hash of vec_id); every vector
is indexed. A bucket of more than ``block`` vectors is dealt to several parts, each of which gets the queries that visit the
bucket, so equal vectors in any number land in no single task; no candidate is dropped.

Cases: vectors that are null, zero, or hold null or non-finite parts, and vectors of a length other than the commonest, take
no part, neither as queries nor as candidates; ties go to the smaller vec_id; rows with a null vec_id take no part; rows
that repeat a vec_id are each a candidate and one result (the nearest); an empty table gives an empty result; a query with
fewer than ``k`` other vectors gets those; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved, spread

RESULT = "query_id long, vec_id long, score double"
_ERF = np.vectorize(math.erf, otypes=[float])


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (commonest.d if commonest else 0))


class Tables:
    """The hash functions, derived from a seed."""

    def __init__(self, dimension: int, distance: float, tables: int, functions: int, width: float, success: float, seed: int = 7):
        r = np.random.default_rng(seed)
        self.distance, self.width = distance, width * distance
        self.directions = r.standard_normal((tables, functions, dimension))
        self.shifts = r.random((tables, functions)) * self.width
        self.share = 1 - (1 - success) ** (1 / tables)

    def project(self, table: int, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.directions[table].T + self.shifts[table]) / self.width

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        key = np.zeros(cells.shape[:-1], np.int64)
        for i in range(cells.shape[-1]):
            key = key * 1_000_003 + cells[..., i]
        return key

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Bucket keys in the order of estimated success, for a query's projections in one table."""
        reach = math.ceil(4 * self.distance / self.width)
        cells = np.floor(place)[:, None] + np.arange(-reach, reach + 1)
        area = lambda x: _ERF((x - place[:, None]) * self.width / (self.distance * math.sqrt(2))) / 2
        chance = area(cells + 1) - area(cells)
        order = np.argsort(-chance, axis=1, kind="stable")
        cells, chance = np.take_along_axis(cells, order, 1).astype(np.int64), np.take_along_axis(chance, order, 1)
        cost = -np.log(np.maximum(chance, 1e-300))
        heap, out, sure = [(float(cost[:, 0].sum()), (0,) * len(place), 0)], [], 0.0
        steps = cost.tolist()
        while heap and sure < self.share:
            total, at, last = heapq.heappop(heap)
            out.append(at)
            sure += math.exp(-total)
            for i in range(last, len(at)):  # raising only from the last raised on reaches each set once
                if at[i] + 1 < cells.shape[1]:
                    heapq.heappush(heap, (total - steps[i][at[i]] + steps[i][at[i] + 1], (*at[:i], at[i] + 1, *at[i + 1 :]), i))
        return self.key(cells[np.arange(len(place)), np.array(out)])


def fit(vectors: DataFrame, tables: int, functions: int, width: float, success: float, sample: int) -> Tables | None:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not rows:
        return None
    x = np.array([r.v for r in rows])
    square = (x**2).sum(1)
    d2 = np.maximum(square[:, None] + square - 2 * x @ x.T, 0)
    d2[d2 <= 1e-12 * max(1.0, square.max())] = np.inf  # itself and its copies
    nearest = np.sqrt(d2.min(1))
    nearest = nearest[np.isfinite(nearest)]
    return Tables(x.shape[1], float(np.quantile(nearest, 0.9)) if len(nearest) else 1.0, tables, functions, width, success)


def closest(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, v: np.ndarray, k: int, seen: Callable[[slice], np.ndarray] | None = None, cells: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its id repeated, and the ids and distances of its ``k`` nearest rows but its own, ties to the smaller id; ``seen`` gives the rows that queries may meet.

    Squared distances by products, for about ``cells`` pairs at a time, leave the rows that are as near as the k-th or within rounding of it; these get
    their distance by differences. Only results are kept.
    """
    out, step = [], max(1, cells // max(1, len(ids)))
    square = (x**2).sum(1)
    for a in range(0, len(queries), step):
        part = slice(a, a + step)
        q, w = queries[part], v[part]
        with np.errstate(over="ignore", invalid="ignore"):
            near = (w**2).sum(1)[:, None] + square - 2 * (w @ x.T)
            slack = 1e-9 * ((w**2).sum(1) + square.max(initial=0.0))
        allowed = ids != q[:, None]
        if seen is not None:
            allowed &= seen(part)
        plain = ~(np.isfinite(near) & np.isfinite(slack)[:, None]).all(1)  # squares beyond the doubles' range: by differences alone
        near[~allowed] = np.inf
        edge = np.partition(near, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q), np.inf)
        for i in range(len(q)):
            every = allowed[i]
            at = np.flatnonzero(every if plain[i] else every & (near[i] <= edge[i] + slack[i]))
            best = _ranked(ids, x, w[i], at, k)
            if len(best[0]) < k and len(at) < every.sum():  # rows that repeat a vec_id took the places of others
                best = _ranked(ids, x, w[i], np.flatnonzero(every), k)
            out.append((np.full(len(best[0]), q[i]), *best))
    return out


def _ranked(ids: np.ndarray, x: np.ndarray, v: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and distances of the ``k`` nearest of the rows ``at``; of rows that repeat a vec_id the nearest."""
    score = np.sqrt(((x[at] - v) ** 2).sum(1))
    best = np.lexsort((ids[at], score))
    best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])[:k]]
    return ids[at][best], score[best]


def _round(rows: DataFrame, asked: DataFrame, hashing: Tables, k: int, block: int, most: int) -> DataFrame:
    """query_id, vec_id, score: candidates in the buckets that the queries visit, the best of each group of buckets.

    A group holds about four blocks of rows and about ``most`` queries a table at most: where there are more queries, rows go to a group for each slice of them.
    """
    tables = len(hashing.directions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, hashing.directions.shape[2]))
            for t in range(tables):
                key = hashing.key(np.floor(hashing.project(t, x)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(key), b.column("vec_id"), b.column("v")], ["t", "bucket", "vec_id", "v"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column("v").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, hashing.directions.shape[2]))
            for t in range(tables):
                keys = [hashing.probes(p) for p in hashing.project(t, x)]
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), b.column("vec_id"), pa.array(keys, pa.list_(pa.int64()))], ["t", "query_id", "buckets"])

    placed = spread(rows).mapInArrow(place, "t int, bucket long, vec_id long, v array<double>")
    sizes = placed.groupBy("t", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    groups = F.lit(max(1, math.ceil(rows.count() * tables / (4 * block))))
    part_of = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    group = F.pmod(F.xxhash64("t", "bucket", "part"), groups).alias("g")
    slices = max(1, math.ceil(asked.count() / most))
    data = placed.join(sizes, ["t", "bucket"]).select("t", "bucket", part_of.alias("part"), "vec_id", "v").select(group, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), "t", "bucket", "vec_id", "v")
    visits = spread(asked).mapInArrow(visit, "t int, query_id long, buckets array<long>").select("t", "query_id", F.explode("buckets").alias("bucket"))
    visits = visits.join(sizes, ["t", "bucket"]).select("t", "bucket", "query_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # One row for each query and group, with the buckets it visits there.
    visits = visits.groupBy(group, F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("s"), "t", "query_id").agg(F.collect_set("bucket").alias("buckets")).join(asked.select(F.col("vec_id").alias("query_id"), "v"), "query_id")

    def rerank(near: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, own in asks.groupby("t") if len(near) else ():
            some = near[near.t == t]
            if not len(some):
                continue
            keys, place = np.unique(some.bucket.to_numpy(), return_inverse=True)
            buckets = own.buckets.to_numpy()

            def seen(part: slice, keys: np.ndarray = keys, place: np.ndarray = place, buckets: np.ndarray = buckets) -> np.ndarray:
                asked_for = np.concatenate(buckets[part])
                query, at = np.repeat(np.arange(len(buckets[part])), [len(b) for b in buckets[part]]), np.searchsorted(keys, asked_for)
                here = keys[np.minimum(at, len(keys) - 1)] == asked_for  # not where this part of the bucket got no row
                visited = np.zeros((len(buckets[part]), len(keys)), bool)
                visited[query[here], at[here]] = True
                return visited[:, place]

            out += closest(some.vec_id.to_numpy(), np.stack(some.v.to_numpy()), own.query_id.to_numpy(), np.stack(own.v.to_numpy()), k, seen)
        return pd.DataFrame({n: np.concatenate([o[i] for o in out] or [np.zeros(0, kind)]) for i, (n, kind) in enumerate((("query_id", "int64"), ("vec_id", "int64"), ("score", "float64")))})

    return data.groupBy("g", "s").cogroup(visits.groupBy("g", "s")).applyInPandas(rerank, RESULT)


def scan(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """query_id, vec_id, score: the nearest of every batch of ``rows`` to each of ``asked`` (vec_id, v), by comparing all."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in asked]), np.array([r.v for r in asked])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = np.stack(b.column("v").to_numpy(zero_copy_only=False)), b.column("vec_id").to_numpy()
            found = closest(ids, x, queries, q, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, RESULT)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 2, functions: int = 4, width: float = 0.8, success: float = 0.97, sample: int = 1024, block: int = 4096, rounds: int = 3, growth: float = 3.0, most: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` nearest found in ``vectors`` for each of ``queries`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ready(spark)
    rows, asked = valid(vectors), valid(queries)
    hashing = fit(rows, tables, functions, width, success, sample)
    if hashing is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found, left, reach = None, asked, hashing.distance
    for step in range(rounds):
        if step:
            reach *= growth
            hashing = Tables(hashing.directions.shape[2], reach, tables, functions, width, success, seed=7 + step)
        more = _round(rows, left, hashing, k, block, most)
        found = saved(more if found is None else found.unionByName(more), "near")
        own = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("scores"))
        full = own.where((F.size("scores") >= k) & (F.get("scores", F.lit(k - 1)) <= reach)).select(F.col("query_id").alias("vec_id"))
        left = saved(left.join(full, "vec_id", "left_anti"), "left")
        if left.isEmpty():
            break
    n = math.ceil(left.count() / block)
    for part in range(n):  # at most about ``block`` queries at a time against all rows
        some = left.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == part).collect()
        if some:
            found = found.unionByName(saved(scan(spread(rows), some, k), "scanned"))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
