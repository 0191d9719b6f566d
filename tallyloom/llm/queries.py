"""The registered queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import backoff, common, id_files, lexical, nearest, oracles, packing, parity_join, phrases, quality, secrets, tiff, token_counts, toxicity, transducer


def tokenizer(name: str) -> str:
    return public_tokenizers.path(name)


def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join(common.table(spark, sf_dir, "documents"))


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_features(common.table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    cache = f"{common.scratch(spark)}/token-cache-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts.token_counts(docs, tokenizer("byte_bpe_50k.json"), cache)


def op6_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(common.table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), with_ids=False).drop("ids")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digests(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.scratch(spark)}/ids-{uuid.uuid4().hex[:12]}"
    id_files.write_ids(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path)
    return id_files.read_ids(spark, path, with_ids=False).drop("ids")


def op11_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(common.table(spark, sf_dir, "documents"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{common.scratch(spark)}/secret-ledger-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return secrets.report(common.table(spark, sf_dir, "documents"), ledger)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multiprobe, op2_ngram_jaccard, op3_tiff, op4_toxicity, op5_token_counts, op6_backoff, op7_quality, op8_packing, op9_bpe_transducer, op10_id_files, op11_branch_and_bound, op12_norm_buckets, op13_blob_ledger)}
ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
