"""Exact ranks, running numbers and quantiles that survive hot keys and hot values.

Nothing here sorts or collects a whole group in one task. Equal values are first collapsed to one
counted row (map-side combine), the counted rows are cut into value ranges, and ranges carry offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect.session import staged

BLOCK_ROWS = 1 << 16


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet; the keys come from the left."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])


def row_number_within(
    df: DataFrame, keys: list[str], seq: str, out: str,
    *, starts: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its keys, ordered by the unique integer seq.

    A group is cut into blocks of block_rows consecutive seq values, so a block never holds more than
    block_rows rows however hot the group is; block totals give each block its offset. starts may
    hold one row (keys, start) per key, added to the positions of that key. NULL is a key like any other.
    """
    blocked = df.withColumn("_block", F.floor(F.col(seq) / block_rows))
    totals = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    if starts is not None:
        offsets = join_null_safe(offsets, starts, keys).select(
            *keys, "_block", (F.col("_offset") + F.col("start")).alias("_offset")
        )
    within = W.partitionBy(*keys, "_block").orderBy(seq)
    return (
        join_null_safe(blocked, offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.row_number().over(within))
        .drop("_block", "_offset")
    )


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value): n rows have it, `before` rows are smaller, `total` rows in the key.

    The value may be of any type that can be ordered. NULL and NaN values and NULL keys are left out. Equal values
    collapse to counts on the map side; the counts are dealt by ranges of (keys, value) and staged with the
    number of their range, so that ranges are ordered side by side and range totals give each its exact offset.
    Small tables end up in one range.
    """
    present = F.col(value).isNotNull()
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        present &= ~F.isnan(value)
    for key in keys:
        present &= F.col(key).isNotNull()
    collapsed = df.where(present).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = collapsed.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id())
    counts = staged(ranged, "counts")
    # One row per key and range reaches these windows.
    lower = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_rows")).select(
        *keys, "_range", F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("total"),
    )
    running = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        counts.withColumn("_inside", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .join(offsets, [*keys, "_range"])
        .select(*keys, value, "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total")
    )


def value_at(value: str, index: Column) -> Column:
    """Aggregate over cumulative counts: the value at a 0-based position of its sorted key."""
    hit = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
    return F.max(F.when(hit, F.col(value)))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of shares."""
    cumulative = cumulative_counts(df, keys, value)
    columns = []
    for name, share in shares.items():
        spot = (F.col("total") - 1) * F.lit(float(share))
        low = value_at(value, F.floor(spot)).cast("double")
        high = value_at(value, F.ceil(spot)).cast("double")
        part = F.max(spot - F.floor(spot))
        columns.append((low + (high - low) * part).alias(name))
    return cumulative.groupBy(*keys).agg(*columns)


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank of each distinct value; ties share the average of their positions."""
    return cumulative_counts(df, keys, value).withColumn(
        "rank", F.col("before") + (F.col("n") + 1) / 2.0
    )


def join_counted(
    rows: DataFrame, counted: DataFrame, keys: list[str], hot_share: float = 0.01
) -> DataFrame:
    """Join rows to counted values without sending a hot value to one task.

    A value that holds hot_share of its key's rows is hot. A key has at most 1/hot_share hot values,
    which bounds the broadcast side whatever the data; all other values go through a shuffle join.
    """
    hot = F.col("n") >= F.col("total") * F.lit(hot_share)
    head = counted.where(hot)
    cold_rows = rows.join(F.broadcast(head.select(*keys)), keys, "left_anti")
    spread = cold_rows.join(counted.where(~hot), keys)
    return rows.join(F.broadcast(head), keys).unionByName(spread)
