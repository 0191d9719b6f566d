"""Helpers shared by the operators: shared scratch tables, table reading, Arrow batches and word hashing.

``word_hashes`` turns a block of texts into 64-bit word hashes with array operations only: every byte is mapped to a
64-bit value, values are summed against powers of an odd base, and a word's hash is a difference of two prefix sums.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where none is set."""
    ready(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``saved`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """More, smaller partitions when the input has fewer than the cores at hand (a small file in one split)."""
    sc = df.sparkSession.sparkContext
    return df.repartition(least or sc.defaultParallelism) if df.rdd.getNumPartitions() < 2 else df


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one where nothing has been written. A table that can't be read is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 5 = 0; false for a null doc_id, which has no remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def blocks(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the bytes of ``column`` in each stay near ``size``; a larger row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        group = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def planes(a: np.ndarray) -> bytes:
    """Numbers compressed with their bytes of like weight together."""
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def unplanes(data: bytes, kind: str) -> np.ndarray:
    data, size = zstandard.decompress(data), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed public multipliers)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words when punctuation isn't part of them: ASCII but letters and digits.
BREAKS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(texts: list[bytes | None], breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes joined by line ends, words' starts and ends in them, and words per text."""
    data = np.frombuffer(b"\n" + b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    space = breaks[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    edges = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, edges))
    return data, starts, ends, counts


def word_hashes(texts: list[bytes | None], lower: bool = True, breaks: np.ndarray = _SPACE, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes not in ``breaks``, A-Z lower-cased) in order, and the words of each text.

    With ``first``, a word's hash is that of its first so many bytes.
    """
    data, starts, ends, counts = word_spans(texts, breaks)
    if first:
        ends = np.minimum(ends, starts + first)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)])])
    return mix((sums[ends] - sums[starts]) * down[starts]), counts
