"""A corpus made ready for training: five stages over `documents`, each one operator of `skeinwatch.llm`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.llm import bpe_codec, decontaminate, quality, secret_scan, simhash
from skeinwatch.sources.work import materialize


_BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on Python gets texts by 1,000 rows, or fewer if the session says so.

    A batch is held as Arrow by the JVM, outside its heap, and as Arrow, strings and results by the worker. Results are lazy, so the
    setting stays with the session. Zero and less mean no limit.
    """
    set_ = int(spark.conf.get(_BATCH))
    if not 0 < set_ <= _BATCH_ROWS:
        spark.conf.set(_BATCH, _BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    small_batches(spark)
    return quality.assess(docs).filter("kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8) stays: that with the least doc_id."""
    small_batches(spark)
    return simhash.keep_one_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with a benchmark item go."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and the digests of ids and of the text decoded from them.

    The codec remembers less than by default: executors come to this stage with full heaps.
    """
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=True, max_states=100_000, max_pieces=80_000).drop("text")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]
#: No SQL has the stages' tokenizer, hashes and models; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`. Each result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
