"""Shares, column profiles and rank correlation."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.operators.ranking import average_ranks, join_counted, quantiles
from metrospect.operators.selection import long_metrics


def share(df: DataFrame, key: str) -> DataFrame:
    """Rows and percent of all rows per value of key; counted once, the total sums the counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("n_rows") / total)


def moments_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """count, mean, sample std, min and max per key and column: one pass over the wide rows."""
    fields = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"), F.col(f"{c}_n").alias("n"),
                F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"),
                F.col(f"{c}_min").alias("min"), F.col(f"{c}_max").alias("max"),
            )
            for c in columns
        ]
    )
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.count(value).alias(f"{c}_n"), F.avg(value).alias(f"{c}_mean"),
            F.stddev_samp(value).alias(f"{c}_std"), F.min(value).alias(f"{c}_min"),
            F.max(value).alias(f"{c}_max"),
        ]
    wide = df.groupBy(*keys).agg(*aggregates)
    return wide.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.*")


def column_profile(df: DataFrame, columns: list[str] = K.METRICS) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column."""
    long = long_metrics(df, [], columns)
    quartiles = quantiles(long, ["metric"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments_long(df, [], columns).join(quartiles, "metric", "left")


def rank_matrix(df: DataFrame, record: str, columns: list[str]) -> DataFrame:
    """Average rank of every column per record; df should be staged, it is read several times."""
    long = long_metrics(df, [record], columns).where(F.col("value").isNotNull())
    ranked = join_counted(
        long, average_ranks(long, ["metric"], "value"), ["metric", "value"]
    )
    return ranked.groupBy(record).agg(
        *[F.max(F.when(F.col("metric") == c, F.col("rank"))).alias(c) for c in columns]
    )


def spearman(
    df: DataFrame, record: str, columns: list[str] = K.METRICS,
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Spearman correlation of column pairs as (metric_a, metric_b, rho); NULL if one is constant.

    The population is the rows that have all columns of the pairs; ranks, means and deviations are taken
    over these rows alone. NaN counts as absent.
    """
    pairs = pairs or list(itertools.combinations(columns, 2))
    columns = [c for c in columns if any(c in pair for pair in pairs)]
    columns += [c for pair in pairs for c in pair if c not in columns]
    columns = list(dict.fromkeys(columns))
    ranks = rank_matrix(df.na.drop("any", subset=columns), record, columns)
    covers = [F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    spreads = [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    row = ranks.agg(*covers, *spreads)
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                F.try_divide(F.col(f"c{i}"), F.col(f"s_{a}") * F.col(f"s_{b}")).alias("rho"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return row.select(F.explode(cells).alias("c")).select("c.*")
