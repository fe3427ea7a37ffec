"""Batches in stored order and in length order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.operators.ranking import cumulative_counts, row_number_within


def overflow_flags(
    df: DataFrame, position: str, tokens: str, batch_size: int, limit: int = K.MAX_TOKENS
) -> DataFrame:
    """Add batch, padded length of the batch and whether it overflows; position counts from 0.

    A batch has at most batch_size rows, so the window over it is bounded.
    """
    batch = F.floor(F.col(position) / batch_size)
    members = W.partitionBy("batch")
    return (
        df.withColumn("batch", batch)
        .withColumn("padded", F.max(tokens).over(members))
        .withColumn("overflow", F.col("padded") > limit)
    )


def without_overflow(
    df: DataFrame, position: str, tokens: str, batch_size: int, limit: int = K.MAX_TOKENS
) -> DataFrame:
    """Drop every batch whose longest member exceeds the limit."""
    return overflow_flags(df, position, tokens, batch_size, limit).where(~F.col("overflow"))


def length_batches(df: DataFrame, length: str, record: str, batch_size: int) -> DataFrame:
    """Add position in (length, record) order and batch = position div batch_size.

    Position = rows with a shorter length + place among equal lengths; neither part sorts globally.
    Rows without a length come last.
    """
    lengths = df.select(F.col(length).alias("_length"))
    shorter = cumulative_counts(lengths, [], "_length").select(
        F.col("_length").alias(length), F.col("before").alias("start")
    )
    unknown = lengths.agg(F.count("_length").alias("start")).select(
        F.lit(None).cast(df.schema[length].dataType).alias(length), "start"
    )
    shorter = shorter.unionByName(unknown)
    placed = row_number_within(df, [length], record, "_place", starts=shorter)
    return (
        placed.withColumn("position", F.col("_place") - 1)
        .withColumn("batch", F.floor(F.col("position") / batch_size))
        .drop("_place")
    )


def padding_report(df: DataFrame, length: str) -> DataFrame:
    """Rows, padded length and padding waste of each batch."""
    n, longest = F.count(F.lit(1)), F.max(length)
    return df.groupBy("batch").agg(
        n.alias("n_rows"),
        longest.cast("long").alias("padded"),
        (n * longest - F.sum(length)).cast("long").alias("waste"),
    )
