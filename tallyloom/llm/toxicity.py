"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct buckets (2**``BITS``) of its words, word pairs and pairs with one word left out, and of
its words' first ``STEM`` bytes, which inflected words share; words are runs of letters and digits, A-Z lower-cased. FTRL keeps a rate per coordinate and sets weights of weak evidence to
exactly zero (L1), so the model is a short list of buckets and weights that is broadcast to score every text in full.

The fit takes a bounded sample of labelled rows (``sample``), in one task; features are made in parallel before it.

Cases: null and empty texts score the model's bias; very long texts are scored whole; equal texts get equal scores;
repeated rows are each scored; null labels are left out and, of repeated ones, the largest holds; with no labelled row every
score is 0; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BREAKS, blocks, held_out, mix, ready, spread, word_hashes
from .labels import in_one_task, sample_labelled

BITS = 20
BIAS = 1 << BITS
STEM = 5


def buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts with repeats, and the text each comes from."""
    words, counts = word_hashes(texts, breaks=BREAKS)
    stems, _ = word_hashes(texts, breaks=BREAKS, first=STEM)
    of = np.repeat(np.arange(len(texts)), counts)
    shift = np.uint64(64 - BITS)
    out, owner = [words >> shift, mix(stems + np.uint64(1)) >> shift], [of, of]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = of[gap:] == of[:-gap]
        out.append((mix(words[:-gap][same] * np.uint64(salt) + words[gap:][same]) >> shift))
        owner.append(of[gap:][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.1, passes: int = 4, toxic: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights (buckets, values) after ``passes`` over the examples (distinct buckets, label).

    An example of label 1, the rarer, counts ``toxic`` times.
    """
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(passes):
        for at, y in examples:
            w, ns = weights(at), n[at]
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= toxic if y else 1.0
            if g * g < 1e-8:
                continue
            z[at] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    at = np.flatnonzero(np.abs(z) > l1)
    return at, weights(at)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = 16_000) -> tuple[np.ndarray, np.ndarray] | None:
    ready(docs.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            at, of = buckets(batch.column("text").cast(pa.binary()).to_pylist())
            keys = np.unique((of << np.int64(BITS)) | at)
            cuts = np.searchsorted(keys >> BITS, np.arange(batch.num_rows + 1))
            rows = [(keys[a:b] & (BIAS - 1)).astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.append(np.frombuffer(a, "<u4").astype(np.int64), BIAS), y) for b in batches for a, y in zip(b.column("at").to_pylist(), b.column("y").to_pylist())]
        if examples:
            at, w = ftrl(examples)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([w.astype("<f8").tobytes()], pa.binary())], ["at", "w"])

    rows = sample_labelled(docs, labels, column, sample).mapInArrow(featurise, "doc_id long, y int, at binary")
    model = in_one_task(rows).mapInArrow(learn, "at binary, w binary").first()
    return (np.frombuffer(model.at, "<i8"), np.frombuffer(model.w, "<f8")) if model else None


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, name: str = "score") -> DataFrame:
    """``docs`` (with a column text) and its score, 0 to 1, as column ``name``, which takes the place of one so named."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.drop(name).schema.add(name, "double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BIAS + 1)
        if shared.value:
            weights[shared.value[0]] = shared.value[1]
        else:
            weights[BIAS] = -np.inf
        for batch in blocks(batches, "text", 1 << 20):
            at, of = buckets(batch.column("text").cast(pa.binary()).to_pylist())
            some = weights[at] != 0
            keys = np.unique((of[some] << np.int64(BITS)) | at[some])
            sums = np.bincount(keys >> BITS, weights[keys & (BIAS - 1)], batch.num_rows) + weights[BIAS]
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-sums))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(scores)], names)

    return docs.drop(name).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 16_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    docs = spread(docs.select("doc_id", "text"))
    scored = score(docs, fit(docs, labels, sample=sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
