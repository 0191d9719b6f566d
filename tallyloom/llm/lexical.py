"""Ranked lexical search for a set of items by buckets of impact vectors of like length.

A document's vector has, for each term of the items, its impact v (integer, from the term's count and the document's length) times
the root of the term's weight w; an item's has that root times the term's repeats, so their product is the score. Vectors are
ordered by length and cut into buckets of at most ``block`` documents. The longest ``lead``-th part is searched first and gives each item a
threshold, the score of its k-th there. In every bucket an item is passed over when its length times the bucket's greatest
is under the threshold (Cauchy-Schwarz); else its largest coordinates are met exactly and the rest is bounded
by the lengths that remain, and only documents whose bound reaches the threshold are scored, in 64-bit integers over all terms. Bounds
are taken a billionth wider than computed, so rounding loses nothing: the result is exact.

The items are a stated query set: at most ``items_a_block`` of them are sent out at a time, with their terms and thresholds, and meet all documents. Only
terms of items are kept of a document. Equal lengths in any number are dealt to buckets by a hash of the row. Terms go by 64-bit hashes:
a chance of about v * d / 2^64 for v terms of items and d different ones of documents that two are taken for one.

Cases: null and empty texts have no terms, count nowhere and are never found; items without terms, or with none that a document has, give no
rows; ties go to the smaller doc_id (null last); rows that repeat a doc_id are documents of their own; items that repeat item_id and text
are one, a null item_id is kept; empty tables give an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RESULT = "item_id long, rank int, doc_id long, score long"
VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
SLACK = 1 + 1e-9


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms), terms (places in the sorted ``vocabulary`` of hashes) and counts of each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", 4 << 20):
            h, n = common.word_hashes(b.column("text").cast(pa.binary()).to_pylist(), True, common.BREAKS)
            at = np.searchsorted(vocabulary, h).clip(max=len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == h)
            pairs, counts = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(vocabulary) + at[hit], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(vocabulary)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % len(vocabulary), counts)]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The integer impact of a term met ``tf`` times in a document of ``n`` terms."""
    if int(n.max(initial=0)) * 75 * documents >= 1 << 62:
        n = n.astype(object)
    m = 100 - 75 + np.asarray((75 * n * documents) // terms).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """Items as vectors: places and repeats of their terms, and the terms' weights."""

    def __init__(self, terms: list[Counter], weights: np.ndarray):
        self.weights, self.roots = weights, np.sqrt(weights.astype(float))
        self.terms, self.coordinates, self.factors = [], [], []
        for own in terms:
            t = np.array(sorted(own), np.int64)
            x = self.roots[t] * np.array([own[i] for i in t.tolist()], float)
            order = np.argsort(-x, kind="stable")
            order = order[x[order] > 0]
            self.terms.append(t[order])
            self.coordinates.append(x[order])
            self.factors.append(np.array([own[i] for i in t[order].tolist()], np.int64) * weights[t[order]])
        self.lengths = np.array([math.sqrt((x**2).sum()) for x in self.coordinates])


class Bucket:
    """Documents of like length, longest first: their entries by document and by term."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, v: np.ndarray, roots: np.ndarray):
        rows = np.repeat(np.arange(len(ids)), np.diff(offsets))
        x = roots[terms] * v
        norms = np.sqrt(np.bincount(rows, x**2, len(ids)))
        order = np.argsort(-norms, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.norms, rows = ids[order], norms[order], place[rows]
        entries = np.lexsort((rows, terms))
        self.rows, self.v, self.x = rows[entries], v[entries], x[entries]
        self.edges = np.searchsorted(terms[entries], np.arange(len(roots) + 1))

    def best(self, items: Items, i: int, threshold: int, k: int, focus: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the item's ``k`` best here among those that reach the threshold."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.norms) or not items.lengths[i] or items.lengths[i] * self.norms[0] * SLACK < threshold:
            return none
        few = int(np.searchsorted(-self.norms, -threshold / (items.lengths[i] * SLACK), "right"))  # shorter ones can't reach it
        terms, q = items.terms[i], items.coordinates[i]
        left = np.sqrt(np.maximum(items.lengths[i] ** 2 - np.cumsum(q**2), 0))
        met = min(len(terms), int(np.searchsorted(-left, -focus * items.lengths[i])) + 1)
        part, square = np.zeros(len(self.norms)), np.zeros(len(self.norms))
        for t, c in zip(terms[:met].tolist(), q[:met].tolist()):
            a, b = self.edges[t], self.edges[t + 1]
            part[self.rows[a:b]] += c * self.x[a:b]
            square[self.rows[a:b]] += self.x[a:b] ** 2
        part, square = part[:few], square[:few]
        if few > k:  # what the documents of the largest parts score is a threshold, too
            score = self.exact(items, i, np.argpartition(-part, k - 1)[:k])
            threshold = max(threshold, int(score.min()))
        rest = left[met - 1] * np.sqrt(np.maximum(self.norms[:few] ** 2 - square, 0) + 1e-9 * self.norms[:few] ** 2)
        rows = np.flatnonzero((part + rest) * SLACK >= threshold)
        score = self.exact(items, i, rows)
        rows, score = rows[score >= threshold], score[score >= threshold]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]

    def exact(self, items: Items, i: int, rows: np.ndarray) -> np.ndarray:
        """Integer scores of ``rows`` over all terms of the item."""
        place = np.full(len(self.norms), -1)
        place[rows] = np.arange(len(rows))
        score = np.zeros(len(rows), np.int64)
        for t, f in zip(items.terms[i].tolist(), items.factors[i].tolist()):
            a, b = self.edges[t], self.edges[t + 1]
            at = place[self.rows[a:b]]
            score[at[at >= 0]] += f * self.v[a:b][at >= 0]
        return score


NULL = np.iinfo(np.int64).max


def _search(vectors: DataFrame, items: Items, thresholds: np.ndarray, documents: int, terms: int, k: int, focus: float) -> DataFrame:
    """item, doc_id, score: each bucket's best for each item."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, thresholds))

    def run(table: pa.Table) -> pa.Table:
        own, least = sent.value
        table = table.combine_chunks()
        n = table["n"].to_numpy()
        lists = table["terms"].chunk(0)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        t, tf = lists.flatten().to_numpy(), table["counts"].chunk(0).flatten().to_numpy().astype(np.int64)
        v = impacts(tf, np.repeat(n, np.diff(offsets)), documents, terms)
        bucket = Bucket(np.arange(len(n)), offsets, t, v, own.roots)
        # Ties go by doc_id, null last.
        ids = table["doc_id"].fill_null(NULL).to_numpy()
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        back = np.argsort(rank)
        bucket.ids = rank[bucket.ids]
        got = [(i, *bucket.best(own, i, int(least[i]), k, focus)) for i in range(len(own.terms))]
        rows = np.concatenate([np.zeros(0, np.int64), *(back[bucket.ids[r]] for _, r, _ in got)])
        item = np.repeat(np.array([i for i, *_ in got], np.int32), [len(r) for _, r, _ in got])
        score = np.concatenate([np.zeros(0, np.int64), *(s for *_, s in got)])
        return pa.table({"item": pa.array(item, pa.int32()), "doc_id": table["doc_id"].combine_chunks().take(pa.array(rows)), "score": pa.array(score)})

    return vectors.groupBy("bucket", "part").applyInArrow(run, FOUND)


def _buckets(vectors: DataFrame, items: Items, documents: int, terms: int, block: int) -> DataFrame:
    """The vectors with their bucket (0 holds the longest) and its part of at most about ``block`` documents."""
    roots = items.roots

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if b.num_rows else 0)
            rows = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            v = impacts(b.column("counts").flatten().to_numpy().astype(np.int64), b.column("n").to_numpy()[rows], documents, terms)
            norm = np.sqrt(np.bincount(rows, (roots[lists.flatten().to_numpy()] * v) ** 2, b.num_rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], [*b.schema.names, "norm"])

    cuts = min(4096, max(1, math.ceil(documents / block)))
    # A document without weight in any item scores 0 and is found by none.
    normed = common.saved(vectors.mapInArrow(lengths, f"{VECTORS}, norm double").where("norm > 0"), "impacts")
    edges = normed.agg(F.percentile_approx("norm", [i / cuts for i in range(1, cuts)] or [0.5], 20 * cuts)).first()[0]
    edges = -np.unique(edges or [])[::-1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = np.searchsorted(edges, -b.column("norm").to_numpy(), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket)], [*b.schema.names, "bucket"])

    dealt = normed.mapInArrow(deal, f"{VECTORS}, norm double, bucket int")
    parts = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return dealt.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id", "n", "norm", F.monotonically_increasing_id()), "parts"))  # parts: 4096 rows at most


def _block(docs: DataFrame, asked: list, k: int, block: int, lead: int, focus: float) -> DataFrame | None:
    spark = docs.sparkSession
    hashes, sizes = common.word_hashes([(r.text or "").encode() for r in asked], True, common.BREAKS)
    vocabulary = np.unique(hashes)
    if not len(vocabulary):
        return None
    at = np.split(np.searchsorted(vocabulary, hashes), np.cumsum(sizes)[:-1])
    vectors = common.saved(term_counts(docs, vocabulary), "term-counts")
    totals = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not totals.n:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of these items at most
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * totals.n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = Items([Counter(x.tolist()) for x in at], weights)
    dealt = _buckets(vectors, items, totals.n, totals.l, block)
    leading = max(1, math.ceil(totals.n / block / lead))
    search = lambda rows, least: common.saved(_search(rows, items, least, totals.n, totals.l, k, focus), "found")
    first = search(dealt.where(F.col("bucket") < leading), np.ones(len(asked), np.int64))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    least = np.ones(len(asked), np.int64)
    for r in first.withColumn("place", place).where(F.col("place") == k).collect():  # a row for each of these items at most
        least[r.item] = r.score
    rest = search(dealt.where(F.col("bucket") >= leading), least)
    best = first.unionByName(rest).withColumn("place", place).where(F.col("place") <= k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("place").alias("rank"), "doc_id", "score")  # items_a_block rows at most


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = 4096, lead: int = 32, focus: float = 0.5, items_a_block: int = 2048) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    ``focus``: coordinates of an item are met exactly until what is left of its length is this share of it.
    """
    spark = docs.sparkSession
    common.ready(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = math.ceil(asked.count() / items_a_block)
    rows = common.spread(docs)
    found = [_block(rows, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect(), k, block, lead, focus) for b in range(n)]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)
