"""The corpus pipeline: stages over ``documents``, each stored as Parquet and read again by the next.

All but the last return the columns of ``documents``; each decides on every row its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panescan.llm import exact_dedup, minhash_dedup, packing, queries, secret_scan, toxicity
from panescan.llm.common import keep, table
from panescan.session import ship_package

PACKING_BYTES = 16 << 20  # Spark's idle Python workers of earlier stages take their turns in packing, and each remembers


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    ship_package(spark)
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the smallest doc_id stays."""
    ship_package(spark)
    return minhash_dedup.drop_near(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; every document stays."""
    ship_package(spark)
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids."""
    ship_package(spark)
    return packing.pack(docs, queries.word_vocabulary(), with_ids=False, chunk_bytes=PACKING_BYTES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # two stages are trained models; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
