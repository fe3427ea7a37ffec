"""Contrast directions of metrics and their geometry."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metrospect import constants as K
from metrospect.functions.vectors import cosine, mean_vector, norm, principal_angle, subtract
from metrospect.session import broadcast_if_small

#: Sums that a task holds before it passes them on.
SUM_BYTES = 256 << 20


def side_means(joined: DataFrame, max_bytes: int = SUM_BYTES) -> DataFrame:
    """Partial means of the vectors of each (metric, side), layer and pool: rows (metric, side, layer, pool, n, vec).

    A batch's memberships are a matrix of zeros and ones, and its product with the batch's vectors adds them to all
    sides at once. A task passes its sums on when they take max_bytes.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        counts: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            rows = [(*key[:4], counts[key], total / counts[key]) for key, total in sums.items()]
            sums.clear()
            counts.clear()
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, out)], schema=out)

        for batch in batches:
            layers, pools, sides = (batch.column(name).to_pylist() for name in ("layer", "pool", "sides"))
            lengths = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            cells: dict[tuple, list[int]] = defaultdict(list)
            for i, cell in enumerate(zip(layers, pools, lengths.tolist())):
                cells[cell].append(i)
            for (layer, pool, width), rows in cells.items():
                x = batch.column("vec").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), width)
                place: dict[tuple, int] = {}
                marks = [(at, place.setdefault((s["metric"], s["side"]), len(place))) for at, i in enumerate(rows) for s in sides[i]]
                member = np.zeros((len(place), len(rows)))
                for at, side in marks:
                    member[side, at] = 1.0
                for (metric, side), total, n in zip(place, member @ x, member.sum(axis=1)):
                    key = metric, side, layer, pool, width
                    sums[key] = sums[key] + total if key in sums else total
                    counts[key] += int(n)
            if sum(total.nbytes for total in sums.values()) > max_bytes:
                yield passed_on()
        yield passed_on()

    kinds = dict(joined.select("layer", "pool").dtypes)
    schema = f"metric string, side string, layer {kinds['layer']}, pool {kinds['pool']}, n long, vec array<double>"
    out = to_arrow_schema(T._parse_datatype_string(schema))
    present = joined.where(F.col("vec").isNotNull())
    return present.select("layer", "pool", F.col("vec").cast("array<double>").alias("vec"), "sides").mapInArrow(add, schema)


def contrast_vectors(selected: DataFrame, vectors: DataFrame, record: str = "id") -> DataFrame:
    """mean(top) - mean(bottom) per metric, layer and pool.

    Each record carries its few (metric, side) memberships as one array, so a vector is joined once. A small
    membership table is broadcast, so the vectors are summed where they lie.
    """
    side = F.array_compact(
        F.array(
            F.when(F.col("is_top"), F.struct("metric", F.lit("top").alias("side"))),
            F.when(F.col("is_bottom"), F.struct("metric", F.lit("bottom").alias("side"))),
        )
    )
    # Bounded array: at most two sides for each metric of the fixed list.
    member = selected.groupBy(record).agg(F.flatten(F.collect_list(side)).alias("sides"))
    partial = side_means(vectors.join(broadcast_if_small(member, "members"), record))
    means = partial.groupBy("metric", "layer", "pool", "side").agg(mean_vector("vec", "n").alias("vec"))
    sides = means.groupBy("metric", "layer", "pool").agg(
        F.max(F.when(F.col("side") == "top", F.col("vec"))).alias("top"),
        F.max(F.when(F.col("side") == "bottom", F.col("vec"))).alias("bottom"),
    )
    return sides.select("metric", "layer", "pool", subtract("top", "bottom").alias("vec"))


def norm_range(contrast: DataFrame) -> DataFrame:
    """Smallest and largest contrast norm over the layers of each metric."""
    return (
        contrast.withColumn("norm", norm("vec"))
        .groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("n_layers"),
            F.min("norm").alias("min_norm"),
            F.max("norm").alias("max_norm"),
        )
    )


def gram(
    contrast: DataFrame, metrics: list[str] = K.GEOMETRY_METRICS, diagonal: bool = True
) -> DataFrame:
    """Cosine of every unordered metric pair within a layer, without a join.

    One row per layer carries a vector per metric (a fixed list) and is fanned out to the pairs.
    """
    wide = contrast.groupBy("layer", "pool").pivot("metric", metrics).agg(F.first("vec"))
    pairs = itertools.combinations(metrics, 2)
    pairs = [(m, m) for m in metrics] + list(pairs) if diagonal else list(pairs)
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                F.col(a).alias("vec_a"), F.col(b).alias("vec_b"),
            )
            for a, b in pairs
        ]
    )
    cell = wide.select("layer", "pool", F.explode(cells).alias("c")).where(
        F.col("c.vec_a").isNotNull() & F.col("c.vec_b").isNotNull()
    )
    return cell.select(
        "layer", "pool", "c.metric_a", "c.metric_b",
        cosine(F.col("c.vec_a"), F.col("c.vec_b")).alias("cosine"),
    )


def principal_angles(contrast: DataFrame, metrics: list[str] = K.GEOMETRY_METRICS) -> DataFrame:
    """Angle in degrees between the lines of every metric pair, per layer."""
    return gram(contrast, metrics, diagonal=False).withColumn("angle", principal_angle("cosine"))
