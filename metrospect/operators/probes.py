"""Ridge probes and principal components from keyed second moments, exact at every width."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect import constants as K
from metrospect.functions.vectors import dot, has_signal, norm
from metrospect.operators.moments import TILE, Part, parts_of, second_moments
from metrospect.session import broadcast_if_small

RESULT_SCHEMA = (
    "layer int, pool string, metric string, r2_train double, r2_test double, n_train long, "
    "n_test long, intercept double, weights array<double>"
)


def _explained(part: Part, offset: float, slope: np.ndarray) -> float | None:
    """R² of offset + slope·x on the rows behind one set of sums; None without variance."""
    spread = part.syy - part.sy**2 / part.n
    if not spread > 0:
        return None
    fitted = offset * part.sy + slope @ part.sxy
    squared = part.n * offset**2 + 2 * offset * (slope @ part.sx) + part.form(slope)
    return float(1 - (part.syy - 2 * fitted + squared) / spread)


def _solver(alpha: float, tile: int) -> Callable:
    names = [f.name for f in T._parse_datatype_string(RESULT_SCHEMA).fields]

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = parts_of(group, tile)
        train, test = parts.get("train"), parts.get("test")
        if train is None:
            return pd.DataFrame(columns=names)
        n, mean, mean_y = train.n, train.sx / train.n, train.sy / train.n
        inner = train.square()
        inner -= n * np.outer(mean, mean)
        scale = np.sqrt(np.clip(np.diag(inner), 0, None) / n)
        scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
        inner /= scale
        inner /= scale[:, None]
        inner[np.diag_indices_from(inner)] += alpha
        weights = np.linalg.solve(inner, (train.sxy - n * mean * mean_y) / scale)
        slope = weights / scale
        offset = mean_y - slope @ mean
        row = [
            *key, _explained(train, offset, slope),
            None if test is None else _explained(test, offset, slope),
            n, 0 if test is None else test.n, mean_y, weights.tolist(),
        ]
        return pd.DataFrame([row], columns=names)

    return solve


def fit_probes(moments: DataFrame, alpha: float = K.RIDGE_ALPHA, tile: int = TILE) -> DataFrame:
    """Ridge on features standardised by the train rows, with R² on train and test.

    A group holds the tiles of the train and the test sums of one probe, whatever the number of rows:
    about 210 MB at width 5120.
    """
    return moments.groupBy("layer", "pool", "metric").applyInPandas(_solver(alpha, tile), RESULT_SCHEMA)


def probe_sweep(
    vectors: DataFrame, labelled: DataFrame, record: str = "id",
    metrics: list[str] = K.METRICS, alpha: float = K.RIDGE_ALPHA, tile: int = TILE,
) -> DataFrame:
    """Every (layer, pool, metric) probe together, exactly, in one pass over the vectors of any width.

    labelled: record, split, metrics and <metric>_inside flags. Rows count for a probe when the vector
    is not zero, the split is train or test and the metric is strictly inside its limits. A small
    target table is broadcast, so the vectors are not shuffled.
    """
    targets = [
        F.when(F.col(f"{m}_inside"), F.col(m)).cast("double").alias(m) for m in metrics
    ]
    wanted = labelled.where(F.col("split").isin("train", "test")).select(
        record, F.col("split").alias("part"), *targets
    )
    rows = vectors.where(has_signal("vec")).join(broadcast_if_small(wanted, "targets"), record)
    return fit_probes(second_moments(rows, metrics, tile), alpha, tile)


AXES_SCHEMA = "layer int, pool string, n long, mean array<double>, axes array<array<double>>"


def _axes(count: int, tile: int) -> Callable:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = parts_of(group, tile)["all"]
        mean = rows.sx / rows.n
        _, basis = np.linalg.eigh(rows.square() / rows.n - np.outer(mean, mean))
        axes = basis[:, ::-1][:, :count].T
        largest = axes[np.arange(len(axes)), np.abs(axes).argmax(1)]
        axes = axes * np.sign(largest)[:, None]
        return pd.DataFrame(
            [[*key, rows.n, mean.tolist(), axes.tolist()]],
            columns=["layer", "pool", "n", "mean", "axes"],
        )

    return run


def principal_axes(vectors: DataFrame, count: int = 2, tile: int = TILE) -> DataFrame:
    """Mean and leading principal axes of every layer and pool; an axis' largest loading is positive."""
    rows = vectors.withColumn("part", F.lit("all")).withColumn("one", F.lit(1.0))
    sums = second_moments(rows, ["one"], tile)
    return sums.groupBy("layer", "pool").applyInPandas(_axes(count, tile), AXES_SCHEMA)


def pca_scores(vectors: DataFrame, axes: DataFrame, count: int = 2) -> DataFrame:
    """Scores pc_0.. of every vector; axes hold one row per layer and pool, a grid fixed by the model."""
    centred = F.zip_with("vec", "mean", lambda x, m: x.cast("double") - m)
    scored = vectors.join(F.broadcast(axes), ["layer", "pool"]).withColumn("_centred", centred)
    scores = {f"pc_{i}": dot(F.col("_centred"), F.col("axes")[i]) for i in range(count)}
    return scored.withColumns(scores).drop("_centred", "mean", "axes", "n")


def best_rows(scores: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Best row of each key by the given order; the score table is a small fixed grid."""
    ranked = scores.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_place") == 1).drop("_place")


def best_layers(scores: DataFrame) -> DataFrame:
    """Layer with the highest test R² per pool and metric; the lower layer wins a tie."""
    order = [F.desc("r2_test"), F.asc("layer")]
    return best_rows(scores, ["pool", "metric"], order).select("pool", "metric", "layer", "r2_test")


def best_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Highest test R² and its layer per key, by partial aggregation."""
    ranking = F.struct(F.col("r2_test"), (-F.col("layer")).alias("low"))
    return scores.groupBy(*keys).agg(F.max(ranking).alias("top")).select(
        *keys, F.col("top.r2_test").alias("r2_test"), (-F.col("top.low")).alias("layer")
    )


def winner_models(scores: DataFrame) -> DataFrame:
    """Model with the highest test R² per pool and metric, with its best layer."""
    order = [F.desc("r2_test"), F.asc("model"), F.asc("layer")]
    best = best_rows(scores, ["pool", "metric"], order)
    return best.select("pool", "metric", "model", "layer", "r2_test")


def score_pivot(scores: DataFrame, rows: str | list[str], metrics: list[str] = K.METRICS) -> DataFrame:
    """Test R² per rows and pool with one column per metric in fixed order; the best of those that share a row."""
    keys = [rows] if isinstance(rows, str) else rows
    return scores.groupBy(*keys, "pool").pivot("metric", metrics).agg(F.max("r2_test"))


def score_curve(scores: DataFrame) -> DataFrame:
    """Test R² and weight norm along the layers."""
    return scores.select(
        "pool", "metric", "layer", "r2_test", norm("weights").alias("weight_norm")
    ).orderBy("pool", "metric", "layer")
