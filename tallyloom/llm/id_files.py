"""Token ids in compressed shards with a shared zstandard dictionary.

The dictionary is trained on the serialized id arrays (little-endian unsigned 32-bit) of a bounded sample of documents and
is stored once beside the shards. Each document is one zstandard frame of its own, so a short document is read without its
neighbours. A shard is one row of a Parquet table: the dictionary's SHA-256, the first document's place among all ids, the
index (document ids, ends of the frames in the payload, id counts) and the payload of frames. Shards hold documents in
ascending order of doc_id and follow one another.

Order is had without one task seeing everything: documents are range-partitioned by doc_id, each partition is sorted,
encoded and cut into shards in its own task, and sums of the partitions' id totals, by spans of partitions, give the places where they start.

Cases: null and empty texts hold the end id alone; rows with equal doc_id stay apart, in the order of their frames; a null
doc_id sorts first; an empty table gives no shards; extra columns are ignored; very long texts are one frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, ready
from .encoding import encoder

SMALL = 100_000  # shards whose places are broadcast: 2 MB
SPAN = 4096  # buckets summed together
SHARD = "bucket int, shard int, dictionary_sha256 string, n_ids long, doc_ids binary, no_ids binary, ends binary, counts binary, payload binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = 1000, size: int = 65_536) -> bytes:
    """A dictionary of ``size`` bytes from the ids of at most ``sample`` documents (the first by a hash of doc_id)."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.substring("text", 1, 8192).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` numbers
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    encode = encoder(tokenizer).ids
    arrays = [encode(r.text) + np.uint32(end_id).tobytes() for r in texts.collect()]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b"".join(arrays)[-size:].ljust(8, b"\0")


def _shards(tokenizer: str, dictionary: bytes, digest: str, end_id: int, most: int):
    def shard(number: int, rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        ids, counts, frames = zip(*rows)
        none = np.packbits([i is None for i in ids])
        columns = [np.array([i or 0 for i in ids], "<i8").tobytes(), none.tobytes(), np.cumsum([len(f) for f in frames]).astype("<i8").tobytes(), np.array(counts, "<i8").tobytes(), b"".join(frames)]
        plain = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([digest]), pa.array([sum(counts)], pa.int64())]
        return pa.RecordBatch.from_arrays([*plain, *(pa.array([c], pa.binary()) for c in columns)], [c.split()[0] for c in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.uint32(end_id).tobytes()
        press = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary))
        number, size, rows = 0, 0, []
        for batch in blocks(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                rows.append((doc_id, len(ids) // 4, press.compress(ids)))
                size += len(rows[-1][2])
                if size > most:
                    yield shard(number, rows)
                    number, size, rows = number + 1, 0, []
        if rows:
            yield shard(number, rows)

    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, rows_per_bucket: int = 4096, shard_bytes: int = 4 << 20) -> None:
    """Writes the shards of ``docs`` (doc_id, text) under ``path``/shards and their dictionary under ``path``/dictionary."""
    spark = docs.sparkSession
    ready(spark)
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary, end_id)], "sha256 string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    ordered = docs.select("doc_id", "text").repartitionByRange(buckets, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(tokenizer, dictionary, digest, end_id, shard_bytes), SHARD).write.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit; null without ``with_ids``) of every document."""
    ready(spark)
    stored = spark.read.parquet(f"{path}/dictionary").first()
    table = spark.read.schema(SHARD).parquet(f"{path}/shards")
    # Places by a prefix sum in two levels: over the shards of a bucket, over the buckets of a span, and over the spans.
    totals = table.groupBy("bucket").agg(F.sum("n_ids").alias("n")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = totals.groupBy("span").agg(F.sum("n").alias("m")).select("span", (F.sum("m").over(Window.orderBy("span")) - F.col("m")).alias("before"))  # a row for SPAN buckets
    within = Window.partitionBy("span").orderBy("bucket")
    places = totals.withColumn("base", F.sum("n").over(within) - F.col("n")).join(spans, "span").select("bucket", (F.col("base") + F.col("before")).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("shard")
    starts = table.select("bucket", "shard", "n_ids", F.sum("n_ids").over(inside).alias("end")).join(places, "bucket").select("bucket", "shard", (F.col("base") + F.col("end") - F.col("n_ids")).alias("start"))
    dictionary, digest = bytes(stored.dictionary), stored.sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("the shard was written with another dictionary")
                ends, counts = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["counts"], "<i8")
                starts, keys = row["start"] + np.cumsum(counts) - counts, np.frombuffer(row["doc_ids"], "<i8")
                none = np.unpackbits(np.frombuffer(row["no_ids"], np.uint8), count=len(keys)).astype(bool)
                for a in range(0, len(keys), 256):
                    part = slice(a, a + 256)
                    ids = [unpress.decompress(row["payload"][x:y]) for x, y in zip([ends[a - 1] if a else 0, *ends[part][:-1]], ends[part])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part], mask=none[part]), pa.array(starts[part]), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [None] * len(ids), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    if table.count() <= SMALL:  # a row for each shard of some MB; beyond that many, shards and places are both shuffled
        starts = F.broadcast(starts)
    return table.join(starts, ["bucket", "shard"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
