"""Pooling of token states and profiles of vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.functions.vectors import (
    has_signal, mean_vector, nan_elements, norm, population_std_vector,
)


def pool_mean(states: DataFrame, sequence: str = "seq_id") -> DataFrame:
    """Mean of the unmasked positions of each sequence; partial sums before the shuffle. A sequence
    without an unmasked position has no mean: NULL."""
    means = states.where(F.col("mask") == 1).groupBy(sequence).agg(mean_vector("vec").alias("vec"))
    masked = states.groupBy(sequence).agg(F.max(F.coalesce(F.col("mask"), F.lit(0))).alias("_any")).where("_any <> 1")
    return means.unionByName(masked.select(sequence, F.lit(None).cast("array<double>").alias("vec")))


def pool_last(states: DataFrame, sequence: str = "seq_id") -> DataFrame:
    """Vector of the last position of each sequence, masked or not (padding is on the left)."""
    return states.groupBy(sequence).agg(F.max_by("vec", "pos").alias("vec"))


def drop_zero_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where(has_signal("vec"))


def norm_profile(vectors: DataFrame) -> DataFrame:
    """Rows, mean norm, population deviation of the norm and NaN elements per layer and pool."""
    measured = vectors.select(
        "layer", "pool", norm("vec").alias("norm"), nan_elements("vec").alias("nans")
    )
    return measured.groupBy("layer", "pool").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("norm").alias("mean_norm"),
        F.stddev_pop("norm").alias("std_norm"),
        F.sum("nans").alias("nan_count"),
    )


def feature_scales(vectors: DataFrame) -> DataFrame:
    """Mean and population deviation of every dimension per layer and pool; deviation 0 becomes 1."""
    moments = vectors.groupBy("layer", "pool").agg(
        mean_vector("vec").alias("mean"), population_std_vector("vec").alias("std")
    )
    safe = F.transform("std", lambda s: F.when(s > 0, s).otherwise(1.0))
    return moments.withColumn("std", safe)


def standardise(vectors: DataFrame, scales: DataFrame) -> DataFrame:
    """Centre and scale every vector by the scales of its layer and pool.

    Scales hold one row per layer and pool, a grid fixed by the model, so they are broadcast.
    """
    centred = F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m)
    return (
        vectors.join(F.broadcast(scales), ["layer", "pool"])
        .withColumn("vec", F.zip_with(centred, "std", lambda x, s: x / s))
        .drop("mean", "std")
    )
