"""Training-data pipeline over documents: toxicity, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every
stage's rows as Parquet to the shared folder and reads them again as the next one's docs.

Defined cases: null texts count as empty (they are kept as null by the stages that return texts, one of them after
near-dedup, and never mixed, as they hold no words); null ids, sources and languages are values like others;
repeated rows are copies of which one stays; an empty table gives an empty result; further columns, whatever
their names, pass through to the last stage but one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrospect.llm import byte_bpe, mixing, secret_scan, simhash, toxicity
from metrospect.session import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the lexicon, learned from the labels, scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with five-word shingles 0.8 similar: that of the smallest doc_id (nulls last), then the first read."""
    return simhash.first_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; credentials in their texts are replaced by a mark of their kind."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix uses them, range-sorted by training position; texts stay whole."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and hash of the ids, and the hash of the decoded bytes of every row."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

# SQL cannot express the learned lexicon, XXH64 fingerprints or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
