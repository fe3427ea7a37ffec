"""Vector, index, probe and contrast tables as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vector cells by layer and pool; cells that are written anew are replaced, others stay. Ids keep their type."""
    rows = vectors.select("id", F.col("vec").cast("array<float>").alias("vec"), "layer", "pool")
    _replace(rows, path, "layer", "pool")


def read_vectors(
    spark: SparkSession, path: str, layer: int | None = None, pool: str | None = None
) -> DataFrame:
    """Vector table, or one layer or pool of it by partition pruning."""
    df = spark.read.parquet(path)
    if layer is not None:
        df = df.where(F.col("layer") == layer)
    if pool is not None:
        df = df.where(F.col("pool") == pool)
    return df


def write_index(index: DataFrame, path: str) -> None:
    index.select("id", "split").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "split")


def with_metrics(index: DataFrame, metrics: DataFrame, key: str = "id") -> DataFrame:
    """Left join of metrics to the index; raises when a metrics key repeats.

    The key check is part of the join's own row stream: a repeated key would change the row count.
    """
    counted = metrics.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.first(c).alias(c) for c in metrics.columns if c != key],
    )
    sound = F.when(F.col("_n") > 1, F.raise_error(F.lit("a metrics key repeats"))).otherwise(
        F.col(key)
    )
    unique = counted.withColumn(key, sound).drop("_n")
    return index.join(unique, key, "left")


def _replace(rows: DataFrame, path: str, *keys: str) -> None:
    """Write the cells that rows has and leave all others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_probe_results(
    results: DataFrame, path: str, model: str, ridge_alpha: float
) -> None:
    """Probe results with their weights, keyed by model and pool; others in the folder stay."""
    rows = results.withColumn("model", F.lit(model)).withColumn("ridge_alpha", F.lit(ridge_alpha))
    _replace(rows, path, "model", "pool")


def read_probe_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probe_weights(results: DataFrame, layer: int, pool: str, metric: str) -> DataFrame:
    at = (F.col("layer") == layer) & (F.col("pool") == pool) & (F.col("metric") == metric)
    return results.where(at).select("weights")


def write_contrast(contrast: DataFrame, path: str, model: str, p: int) -> None:
    rows = contrast.withColumn("model", F.lit(model)).withColumn("p", F.lit(p))
    _replace(rows, path, "model", "metric", "p")


def read_contrast(
    spark: SparkSession, path: str, model: str | None = None, p: int | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    return df if p is None else df.where(F.col("p") == p)
