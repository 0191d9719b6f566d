"""Token counts with a digest cache.

A text's content digest (SHA-256 of its UTF-8 bytes, null as the empty text) and the tokenizer's digest (SHA-256 of its
file) are the key of a stored count. Counting joins the documents' digests to the cache, encodes each distinct miss once,
and appends what was encoded. Only digests are shuffled for the join; a text moves once, and only if it is a miss.

The content is normalised only in ways that keep every library's count: null becomes the empty text, nothing else.

Cases: null and empty texts count 0 tokens; equal texts get equal counts and are encoded once (only rows that
repeat doc_id and text too are encoded as often as they repeat, and stored once); an empty
table gives an empty result and leaves the cache alone; extra columns are ignored; a null doc_id is kept as it is. Runs that
append the same digest twice are harmless: the cache is read as one count for each key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, stored
from .encoding import encoder

CACHE = "digest string, n_bytes long, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; empty before the first append. A cache that can't be read is an error."""
    return stored(spark, cache, CACHE)


def _counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        for batch in batches:
            n = [len(encode(t)) // 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["digest", "n_bytes", "n_tokens"])

    return count


def append_misses(keyed: DataFrame, tokenizer: str, version: str, cache: str) -> None:
    """Encodes the distinct texts of ``keyed`` (doc_id, digest, text, n_bytes) that the cache lacks and appends them."""
    known = read_cache(keyed.sparkSession, cache).where(F.col("tokenizer") == version).select("digest").distinct()
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(known, "digest", "left_anti")
    texts = keyed.join(firsts.hint("shuffle_hash"), [keyed["digest"] == firsts["digest"], keyed["doc_id"].eqNullSafe(firsts["doc_id"])], "left_semi")
    encoded = texts.select("digest", "n_bytes", "text").mapInArrow(_counts(tokenizer), "digest string, n_bytes long, n_tokens long")
    encoded.dropDuplicates(["digest"]).withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ready(spark)
    version = tokenizer_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    append_misses(keyed, tokenizer, version, cache)
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "n_bytes", "digest").join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
