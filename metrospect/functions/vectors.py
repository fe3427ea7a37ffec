"""Expressions over ARRAY<DOUBLE> vectors, all inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions.text import col


def has_signal(vec: Column | str) -> Column:
    """True when any element differs from zero (NaN differs)."""
    return F.exists(col(vec), lambda x: x != 0)


def nan_elements(vec: Column | str) -> Column:
    return F.size(F.filter(col(vec), lambda x: F.isnan(x)))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column | str) -> Column:
    squares = F.aggregate(
        col(vec), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with each norm floored, so that a zero vector gives 0 and not an error."""
    floor = F.lit(K.NORM_FLOOR)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def principal_angle(cos: Column | str) -> Column:
    return F.degrees(F.acos(F.least(F.abs(col(cos)), F.lit(1.0))))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def mean_vector(vec: Column | str, weight: Column | str | None = None) -> Column:
    """Element-wise (weighted) mean as an aggregate with partial sums on the map side."""
    weights = None if weight is None else col(weight).cast("double")
    return vector_to_array(Summarizer.mean(array_to_vector(col(vec).cast("array<double>")), weights))


def population_std_vector(vec: Column | str) -> Column:
    """Element-wise population standard deviation, as an aggregate."""
    dense = array_to_vector(col(vec).cast("array<double>"))
    variance = vector_to_array(Summarizer.variance(dense))
    n = F.count(col(vec)).cast("double")
    return F.transform(variance, lambda v: F.sqrt(v * (n - 1) / n))
