"""Run configurations and the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions.names import compact_number, report_cell, sweep_name
from metrospect.operators.ranking import row_number_within

SPEC = "array<struct<metric:string,layer:int,alpha:double>>"


def expand_sweeps(runs: DataFrame) -> DataFrame:
    """One run per alpha of a sweep, named after it; a run without a sweep stays as it is."""
    swept = F.col("alpha_sweep").isNotNull()
    spec = F.struct("metric", F.col("layer").cast("int").alias("layer"),
                    F.col("alpha").alias("alpha"))
    rows = runs.where(~swept | (F.size("alpha_sweep") > 0)).withColumn(
        "alpha", F.explode_outer("alpha_sweep")
    )
    return rows.select(
        *[c for c in runs.columns if c not in ("name", "metric", "layer", "alpha_sweep")],
        F.when(swept, sweep_name("name", "alpha")).otherwise(F.col("name")).alias("name"),
        F.when(swept, F.array(spec)).otherwise(F.array().cast(SPEC)).alias("steering"),
    )


def replicate(tasks: DataFrame, n_samples: int) -> DataFrame:
    """Every task n_samples times, numbered by generation_id from 0."""
    return tasks.withColumn("generation_id", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))


def runs_of_model(runs: DataFrame, model: str) -> DataFrame:
    """Runs of one model; having none is an error."""
    chosen = runs.where(F.col("model") == model)
    if chosen.isEmpty():
        raise ValueError(f"no runs found for model {model!r}")
    return chosen


def runs_by_model(runs: DataFrame, seq: str) -> DataFrame:
    """Runs with their place in the queue of their model; queues are rows, not arrays."""
    return row_number_within(runs, ["model"], seq, "place")


def fan_out_base(summaries: DataFrame, metrics: list[str] = K.REPORT_METRICS) -> DataFrame:
    """A base run becomes alpha 0 with zero change for every metric; steered runs pass through."""
    base = F.col("metric").isNull()
    names = F.when(base, F.array(*[F.lit(m) for m in metrics])).otherwise(F.array("metric"))
    return summaries.withColumns(
        {
            "metric": F.explode(names),
            "mean_delta": F.when(base, 0.0).otherwise(F.col("mean_delta")),
            "std_delta": F.when(base, 0.0).otherwise(F.col("std_delta")),
        }
    )


def alpha_ordinals(points: DataFrame) -> DataFrame:
    """Number the alphas of each model from 1, the most negative first."""
    alphas = points.select("pass_k", "model", "alpha").distinct()
    order = W.partitionBy("pass_k", "model").orderBy("alpha")
    return alphas.withColumn("ordinal", F.dense_rank().over(order))


def alpha_agreement(points: DataFrame, metrics: list[str] = K.REPORT_METRICS) -> DataFrame:
    """Per model: number of alphas and whether every metric has every alpha."""
    seen = points.groupBy("pass_k", "model", "alpha").agg(
        F.countDistinct("metric").alias("n_metrics")
    )
    return seen.groupBy("pass_k", "model").agg(
        F.count(F.lit(1)).alias("n_alphas"),
        (F.min("n_metrics") == len(metrics)).alias("agrees"),
    )


def agreeing(points: DataFrame, metrics: list[str] = K.REPORT_METRICS) -> DataFrame:
    """The points; reading them raises where a model's metrics do not have the same alphas."""
    unequal = alpha_agreement(points, metrics).where(~F.col("agrees"))
    bad = unequal.agg(F.min(F.concat_ws(" pass@", "model", "pass_k"))).scalar()
    stop = F.raise_error(F.concat(F.lit("the metrics have different alphas in "), bad)).cast("boolean")
    return points.where(F.when(bad.isNotNull(), stop).otherwise(F.lit(True)))


def final_report(
    points: DataFrame, models: list[str], metrics: list[str] = K.REPORT_METRICS, strict: bool = False
) -> DataFrame:
    """Wide report: one row per pass_k and alpha ordinal, one cell per model and metric; if strict, unequal alphas
    raise."""
    numbered = (agreeing(points, metrics) if strict else points).join(alpha_ordinals(points), ["pass_k", "model", "alpha"])
    cells = numbered.withColumn("column", F.concat_ws("_", "model", "metric")).withColumn(
        "cell", report_cell("mean_delta", "std_delta", "pass")
    )
    columns = [f"{model}_{metric}" for model in models for metric in metrics]
    wide = cells.groupBy("pass_k", "ordinal").pivot("column", columns).agg(F.max("cell"))
    return wide.na.fill(K.MISSING_CELL, columns)


def alpha_legend(points: DataFrame, models: list[str]) -> DataFrame:
    """Alpha behind each ordinal, to four digits, one column per model."""
    named = alpha_ordinals(points).withColumn("alpha", compact_number("alpha", 4))
    return named.groupBy("pass_k", "ordinal").pivot("model", models).agg(F.max("alpha"))
