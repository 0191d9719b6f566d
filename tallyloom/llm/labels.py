"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sample_labelled(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, text and y of at most ``most`` labelled documents outside the held-out fifth, the first by a hash of doc_id.

    Null labels and null doc_ids are left out; of labels that repeat a doc_id the largest holds.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers


def in_one_task(rows: DataFrame) -> DataFrame:
    """The bounded sample in one partition, in an order that doesn't depend on the input's."""
    return rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
