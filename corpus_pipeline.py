"""A corpus pipeline: toxic documents go, poor documents go, one of each group of near copies stays, the rest is packed.

Stages take and return DataFrames; each is written as Parquet and read back as the next one's documents. All but the last
return the columns of documents. A stage fits and decides on what its predecessor kept, and labels of the held-out fifth
are never learned.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import common, packing, parity_join, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Null and empty texts are scored like any other (they stay), a null doc_id is never learned from,
    rows that repeat fall or stay together, and columns of any other names are kept as they are."""
    docs, name = common.spread(docs), common.unused(docs, "_score")
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. Null and empty texts get one score, a null doc_id is never learned from, rows that repeat
    fall or stay together, and columns of any other names are kept as they are."""
    docs, name = common.spread(docs), common.unused(docs, "_score")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the five-word shingle join at a similarity of 0.75: the one of the smallest doc_id (rows that repeat: one of them).
    Documents without words all stay, those with a null doc_id only where the whole component has none."""
    return parity_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids; null and empty texts are an end id alone, and an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("packing", pack)]

#: SQL can express none of the stages' models; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
