"""Distance scores of float32 vectors, lower is nearer. Elements are widened to double before arithmetic and summed left to right."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("l2", "ip")


def _sum(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences, no root."""
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    """Negated inner product; zero is never negative zero."""
    return F.lit(0.0) - _sum(a, b, lambda x, y: x * y)


def score(metric: str, a: Column, b: Column) -> Column:
    """The score of a metric, 'l2' or 'ip'."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}, not {metric!r}")
    return l2_squared(a, b) if metric == "l2" else inner_product(a, b)


def checked(vec: Column, dim: int) -> Column:
    """vec, or an error at run time for a null, of another length, or with a null element (which would score null and sort first)."""
    ok = vec.isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull())
    return F.when(ok, vec).otherwise(F.raise_error(F.concat(F.lit(f"wrong_dimension: expected {dim} elements, got "), F.coalesce(F.size(vec).cast("string"), F.lit("null")))).cast("array<float>"))


def register(spark: SparkSession) -> None:
    """SQL functions tv_l2_squared and tv_inner_product over two arrays."""
    fold = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tv_l2_squared(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {fold.format('(double(x) - double(y)) * (double(x) - double(y))')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tv_inner_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN 0D - {fold.format('double(x) * double(y)')}")
