"""Boundary masks, tail bands and top/bottom selection over metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.operators.ranking import cumulative_counts, quantiles
from metrospect.session import staged


def limits(df: DataFrame, columns: list[str], population: Column | None = None) -> Column:
    """Minimum and maximum of each column over the population, as a scalar subquery struct."""
    rows = df if population is None else df.where(population)
    fields = [F.min(c).alias(f"{c}_min") for c in columns]
    fields += [F.max(c).alias(f"{c}_max") for c in columns]
    return rows.agg(F.struct(*fields).alias("limits")).scalar()


def inside(bounds: Column, column: str) -> Column:
    """Strictly between the minimum and the maximum; a NULL value is outside."""
    value = F.col(column)
    above = value > bounds.getField(f"{column}_min")
    return F.coalesce(above & (value < bounds.getField(f"{column}_max")), F.lit(False))


def with_inside_flags(
    df: DataFrame, columns: list[str] = K.METRICS, population: Column | None = None
) -> DataFrame:
    """Add <column>_inside for each column; population chooses the rows that set the limits."""
    bounds = limits(df, columns, population)
    return df.withColumns({f"{c}_inside": inside(bounds, c) for c in columns})


def all_inside(df: DataFrame, columns: list[str] = K.METRICS) -> DataFrame:
    """Rows strictly inside the limits of every column."""
    bounds = limits(df, columns)
    keep = F.lit(True)
    for c in columns:
        keep &= inside(bounds, c)
    return df.where(keep)


def long_metrics(
    df: DataFrame, ids: list[str], columns: list[str] = K.METRICS, only_inside: bool = False
) -> DataFrame:
    """Unpivot metric columns to (ids, metric, value); only_inside keeps rows flagged inside."""
    if only_inside:
        values = [F.when(F.col(f"{c}_inside"), F.col(c)).cast("double").alias(c) for c in columns]
    else:
        values = [F.col(c).cast("double").alias(c) for c in columns]
    wide = df.select(*ids, *values)
    rows = wide.unpivot(ids, columns, "metric", "value")
    return rows.where(F.col("value").isNotNull()) if only_inside else rows


def shifted_log(df: DataFrame, columns: list[str] = K.METRICS) -> DataFrame:
    """Add <column>_log = ln(1 + value - minimum)."""
    bounds = limits(df, columns)
    return df.withColumns(
        {f"{c}_log": F.log1p(F.col(c) - bounds.getField(f"{c}_min")) for c in columns}
    )


def tail_bands(long: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows at or beyond the exact low and high percentile of their metric; the bottom band wins."""
    cuts = quantiles(long, ["metric"], "value", {"low_cut": low, "high_cut": high})
    percent = f"{round(low * 100)}%"
    band = F.when(F.col("value") <= F.col("low_cut"), f"bottom {percent}").when(
        F.col("value") >= F.col("high_cut"), f"top {percent}"
    )
    # One row per metric, and the metrics are a fixed list.
    return (
        long.join(F.broadcast(cuts), "metric")
        .withColumn("band", band)
        .where(F.col("band").isNotNull())
    )


def _interior(cumulative: DataFrame) -> DataFrame:
    """Cumulative counts without the smallest and the largest value of each metric."""
    n, before, total = F.col("n"), F.col("before"), F.col("total")
    first, last = before == 0, before + n == total
    edges = cumulative.groupBy("metric").agg(
        F.max(F.when(first, n)).alias("_low_n"),
        F.max(F.when(last, n)).alias("_high_n"),
    )
    return (
        cumulative.where(~first & ~last)
        .join(F.broadcast(edges), "metric")
        .select(
            "metric", "value", "n", (before - F.col("_low_n")).alias("before"),
            (total - F.col("_low_n") - F.col("_high_n")).alias("total"),
            (F.col("_low_n") + F.col("_high_n")).alias("dropped"),
        )
    )


def _value_cuts(long: DataFrame, p: float, only_inside: bool) -> DataFrame:
    """Per metric: k, the value where each side ends and how many ties of it are still needed."""
    n, before, total = F.col("n"), F.col("before"), F.col("total")
    k = F.greatest(F.lit(1), F.floor(total * F.lit(float(p)) / 100.0))
    above = total - before - n
    low_end = (before < k) & (before + n >= k)
    high_end = (above < k) & (above + n >= k)
    cumulative = cumulative_counts(long, ["metric"], "value")
    rows = _interior(cumulative) if only_inside else cumulative.withColumn("dropped", F.lit(0).cast("long"))
    return rows.groupBy("metric").agg(
        F.max(total).alias("total"),
        F.max(k).alias("k"),
        F.max("dropped").alias("n_dropped"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.max(F.when(low_end, F.col("value"))).alias("low_value"),
        F.max(F.when(low_end, k - before)).alias("low_need"),
        F.max(F.when(high_end, F.col("value"))).alias("high_value"),
        F.max(F.when(high_end, k - above)).alias("high_need"),
    )


def top_bottom(long: DataFrame, record: str, p: float, only_inside: bool = False) -> DataFrame:
    """Flag the top and bottom k = max(1, int(n * p / 100)) rows of each metric.

    Order is (value, record), record a unique value of any type that can be ordered; only_inside leaves out the
    rows at the minimum and maximum of their metric, n_dropped of them. The ends are found from value counts, then from record counts among
    the rows tied at an end; the selection itself is a filter, so neither a hot value nor the seven
    metric keys limit the parallelism. Both flags may hold for one row.
    """
    cuts = staged(_value_cuts(long, p, only_inside), "cuts")
    value, need = F.col("value"), F.col("_need")
    ends = F.array(
        F.struct(F.lit("low").alias("end"), F.col("low_value").alias("at"),
                 F.col("low_need").alias("need")),
        F.struct(F.lit("high").alias("end"), F.col("high_value").alias("at"),
                 F.col("high_need").alias("need")),
    )
    sides = cuts.select("metric", F.explode(ends).alias("s")).select(
        "metric", F.col("s.end").alias("_end"), F.col("s.at").alias("_at"),
        F.col("s.need").alias("_need"),
    )
    tied = long.join(F.broadcast(sides), "metric").where(value == F.col("_at"))
    places = cumulative_counts(tied, ["metric", "_end"], record).join(
        F.broadcast(sides.select("metric", "_end", "_need")), ["metric", "_end"]
    )
    low = (F.col("_end") == "low") & (F.col("before") + 1 == need)
    high = (F.col("_end") == "high") & (F.col("total") - F.col("before") == need)
    records = places.groupBy("metric").agg(
        F.max(F.when(low, F.col(record))).alias("low_record"),
        F.max(F.when(high, F.col(record))).alias("high_record"),
    )
    full = cuts.join(records, "metric")
    bottom = (value < F.col("low_value")) | (
        (value == F.col("low_value")) & (F.col(record) <= F.col("low_record"))
    )
    top = (value > F.col("high_value")) | (
        (value == F.col("high_value")) & (F.col(record) >= F.col("high_record"))
    )
    return (
        long.join(F.broadcast(full), "metric")
        .where(value.between(F.col("least"), F.col("most")))
        .withColumns({"is_top": top, "is_bottom": bottom})
        .where(F.col("is_top") | F.col("is_bottom"))
        .select(*long.columns, "k", "total", "n_dropped", "is_top", "is_bottom")
    )


def selection_report(selected: DataFrame) -> DataFrame:
    """Rows and value range of each side of each metric, and the rows at the metric's edges that took no part."""
    sides = F.array(
        F.when(F.col("is_top"), F.lit("top")), F.when(F.col("is_bottom"), F.lit("bottom"))
    )
    return (
        selected.withColumn("side", F.explode(F.array_compact(sides)))
        .groupBy("metric", "side")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.max("n_dropped").alias("n_dropped"),
        )
    )
