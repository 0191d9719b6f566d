"""Stupid-backoff scores from n-gram count tables of the whole corpus, each document scored by the other documents' counts.

Documents are gathered, in their tasks, to blocks of some megabytes, a row each of a written table. A block explodes its texts
into n-grams of every order up to ``order`` and sends each distinct one once, with its count there, to the bucket of its hash
(a range of hashes), so a frequent n-gram is pre-aggregated to one entry for each block. A bucket adds up its part of the count tables and joins
the totals back to what the blocks asked for. A block then takes each document's own counts off the totals and sums the
logarithms of its tokens' scores:

S(w | v) = c(vw) / c(v) if c(vw) > 0, else ALPHA * S(w | v without its first word), down to c(w) / N; a word that no other
document has counts as a half.

Words are runs of bytes other than white space, A-Z lower-cased. What is gathered grows with the input: every n-gram of every
document is counted. Hashes have 20 bits more than the number of n-grams needs, so that one in a million n-grams, at any size of
the corpus, shares another's. On their way, sorted hashes travel as differences and all numbers as compressed planes of bytes.

Cases: null, empty and blank texts have no tokens, a sum of 0 and a null mean; very long texts are scored whole, a block of
their own; a corpus of one document scores every token as unknown; equal texts have equal scores; rows that repeat doc_id and
text count as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, planes, ready, saved, spread, unplanes, word_hashes

ALPHA = 0.4
UNKNOWN = 0.5
BLOCK = "block long, n_tokens long, doc_ids binary, no_ids binary, lengths binary, texts binary"  # ids and bytes as 64-bit integers, where ids are null, all texts compressed


def grams(words: np.ndarray, counts: np.ndarray, order: int, bits: int) -> np.ndarray:
    """[k - 1][i]: hash of ``bits`` bits of the k words that end at token i; 0 where the text has too few before it."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((order, len(words)), np.uint64)
    out[0] = words
    for k in range(2, order + 1):
        full = np.flatnonzero(place >= k - 1)
        out[k - 1][full] = mix(out[k - 2][full - 1] * np.uint64(0x9E3779B97F4A7C15) + words[full] + np.uint64(k))
    return np.where(out != 0, np.maximum(out >> np.uint64(64 - bits), np.uint64(1)), np.uint64(0))


def _gather(size: int):
    """Blocks of about ``size`` bytes of text, or as many short rows as fill that with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, at = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            none, texts = np.array([i is None for i, _ in held]), [t or b"" for _, t in held]
            ids, lengths = np.array([i or 0 for i, _ in held], "<i8"), np.array([len(t) for t in texts], "<i8")
            plain = [pa.array([task + at], pa.int64()), pa.array([int(word_hashes(texts)[1].sum())], pa.int64())]
            return pa.RecordBatch.from_arrays([*plain, *(pa.array([x], pa.binary()) for x in (ids.tobytes(), none.tobytes(), lengths.tobytes(), zstandard.compress(b"".join(texts))))], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in blocks(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                more = 64 + len(text or b"")
                if held and n + more > size:
                    yield row()
                    held, n, at = [], 0, at + 1
                held.append((doc_id, text))
                n += more
        if held:
            yield row()

    return run


def _texts(lengths: bytes, data: bytes) -> list[bytes]:
    ends, data = np.cumsum(np.frombuffer(lengths, "<i8")).tolist(), zstandard.decompress(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _ask(order: int, buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _texts(batch.column("lengths")[i].as_py(), batch.column("texts")[i].as_py())
                keys, n = np.unique(grams(*word_hashes(texts), order, bits), return_counts=True)
                keys, n = keys[keys != 0], n[keys != 0].astype("<u4")
                bucket = (((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else np.zeros(1, np.int64)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                number = batch.column("block")[i].as_py()
                columns = [pa.array(bucket[cuts[:-1]] if spans else [], pa.int64()), pa.array([number] * len(spans), pa.int64()), pa.array([planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()), pa.array([planes(n[a:b]) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "counts"])

    return run


def _totals(total: np.ndarray) -> bytes:
    """Totals in four bytes each, or in eight where one needs them: the first byte says which."""
    wide = bool(len(total) and total.max() >> 32)
    return bytes([wide]) + planes(total.astype("<i8" if wide else "<u4"))


def _untotals(data: bytes) -> np.ndarray:
    return unplanes(data[1:], "<i8" if data[0] else "<u4").astype("<i8")


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a bucket's n-grams, for each block in the order it asked."""

    def one(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.cumsum(unplanes(k, "<u8"), dtype=np.uint64) for _, k, _ in rows]
        own = np.concatenate([unplanes(n, "<u4") for *_, n in rows])
        keys = np.concatenate(parts)
        order = np.argsort(keys)
        new = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        sums = np.add.reduceat(own[order].astype(np.int64), new)
        total = np.empty(len(keys), "<i8")
        total[order] = np.repeat(sums, np.diff(np.append(new, len(keys))))
        ends = np.cumsum([len(k) for k in parts]).tolist()
        return pa.RecordBatch.from_arrays([pa.array([b for b, *_ in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array([_totals(total[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())], ["block", "bucket", "totals"])

    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "keys", "counts"))):
            if held and bucket != now:
                yield one(now, held)
                held = []
            now = bucket
            held.append(tuple(row))
    if held:
        yield one(now, held)


def sums(texts: list[bytes | None], totals: np.ndarray, corpus: int, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of logarithms and its number of tokens; ``totals`` are the counts of the texts' distinct n-grams in the order of their hashes."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros(len(texts)), counts
    found = grams(words, counts, order, bits)
    of = np.repeat(np.arange(len(texts)), counts)
    flat, doc = found.ravel(), np.tile(of, order)
    sort = np.argsort(flat, kind="stable")  # documents rise within an n-gram
    key, doc = flat[sort], doc[sort]
    new = np.append(True, key[1:] != key[:-1])
    run = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1]))
    own = np.repeat(np.diff(np.append(run, len(key))), np.diff(np.append(run, len(key))))
    at = np.cumsum(new) - 1
    if key[0] == 0:
        totals = np.append(np.int64(0), totals)
    others = np.empty(len(flat), np.int64)
    others[sort] = np.where(key != 0, totals[at].astype(np.int64) - own, 0)
    others = others.reshape(order, -1)
    score = np.maximum(others[0], UNKNOWN) / np.maximum(1, corpus - counts[of])
    for k in range(1, order):
        context = np.append(0, others[k - 1][:-1])
        score = np.where(others[k] > 0, others[k] / np.maximum(1, context), np.where(found[k] != 0, ALPHA * score, score))
    return np.bincount(of, np.log(score), len(texts)), counts


def score(docs: DataFrame, order: int = 3, block_bytes: int = 4 << 20, tokens_per_bucket: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logarithms) and mean_log_score for each row of ``docs`` (doc_id, text)."""
    ready(docs.sparkSession)
    table = saved(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_gather(block_bytes), BLOCK), "blocks")
    corpus = table.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(1, -(-corpus // tokens_per_bucket))
    bits = min(64, max(32, (order * corpus).bit_length() + 20))
    asked = table.select("block", "lengths", "texts").mapInArrow(_ask(order, buckets, bits), "bucket long, block long, keys binary, counts binary")
    answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_answer, "block long, bucket long, totals binary")

    def total(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("bucket")
        totals = np.concatenate([_untotals(x) for x in found.totals]) if len(found) else np.zeros(0, "<i8")
        s, n = sums(_texts(texts.lengths[0], texts.texts[0]), totals, corpus, order, bits)
        ids = pd.arrays.IntegerArray(np.frombuffer(texts.doc_ids[0], "<i8").copy(), np.frombuffer(texts.no_ids[0], bool).copy())
        return pd.DataFrame({"doc_id": ids, "n_tokens": n, "log_score": s, "mean_log_score": np.where(n > 0, s / np.maximum(1, n), np.nan)})

    rows = table.drop("n_tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(total, "doc_id long, n_tokens long, log_score double, mean_log_score double")
    return rows.withColumn("mean_log_score", F.nanvl("mean_log_score", F.lit(None).cast("double")))
