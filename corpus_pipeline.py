"""Corpus preparation: language ID, exact deduplication, near-deduplication, secret scans, packing.

Every stage takes the table its predecessor wrote, all of its rows and their whole texts. Defined cases are those of the
operators: the language stage drops rejected texts (null, empty and letterless ones among them), exact dedup keeps the
largest doc_id of equal texts, near dedup the smallest doc_id of texts linked by a five-word shingle similarity of 0.8 or
more, the secrets stage replaces spans and keeps every row, and packing returns pieces of token sequences with their ids.
Null doc_ids take part; of whole rows that repeat, one stays; very long texts go through whole; an empty table stays
empty; further columns, whatever their names, come through all stages but the last, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import exact_dedup, langid, minhash, packing, secrets
from gondola.llm.common import Workspace, id_bucket, table, transient


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the language model rejects go."""
    return langid.accepted(spark, docs, langid.train(spark, docs.filter(id_bucket("doc_id", 4) != 2)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word shingle similarity of 0.8 or more one stays."""
    return minhash.dedup(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(spark, docs)


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("secrets", clean), ("packing", packed)]

#: Character models, MinHash and tokenizers are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with transient():  # a stage's own hand-over tables go once its result is written
            docs = space.write(stage(spark, docs, sf_dir), str(k))
        if k:
            space.drop(str(k - 1))
    return docs
