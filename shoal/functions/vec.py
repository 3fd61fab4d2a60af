"""Vector arithmetic and distances as Column expressions.

Vectors are ``array<double>``. With ``d`` (the length, known when the plan is built)
expressions of short vectors are unrolled, so that they stay in generated code; otherwise
they use higher-order array functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPS = 1e-10
INF = float("inf")
#: Longest vectors whose expressions are unrolled.
UNROLL = 16


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(p: Column | str, q: Column | str, d: int | None = None) -> Column:
    p, q = _c(p), _c(q)
    if d and d <= UNROLL:
        return reduce(lambda a, b: a + b, [p[i] * q[i] for i in range(d)])
    return total(F.zip_with(p, q, lambda x, y: x * y))


def sq_euclidean(p: Column | str, q: Column | str, d: int | None = None) -> Column:
    """Squared Euclidean distance; infinite if the lengths differ."""
    p, q = _c(p), _c(q)
    if d and d <= UNROLL:
        return reduce(lambda a, b: a + b, [(p[i] - q[i]) * (p[i] - q[i]) for i in range(d)])
    s = total(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(p) != F.size(q), F.lit(INF)).otherwise(s)


def euclidean(p: Column | str, q: Column | str, d: int | None = None) -> Column:
    return F.sqrt(sq_euclidean(p, q, d))


def norm(p: Column | str, d: int | None = None) -> Column:
    return F.sqrt(dot(p, p, d))


def add(p: Column | str, q: Column | str) -> Column:
    return F.zip_with(_c(p), _c(q), lambda x, y: x + y)


def sub(p: Column | str, q: Column | str) -> Column:
    return F.zip_with(_c(p), _c(q), lambda x, y: x - y)


def scale(p: Column | str, s: float | Column) -> Column:
    return F.transform(_c(p), lambda x: x * s)


def shrink(p: Column | str, mean: Column | str, alpha: float) -> Column:
    """Move ``p`` towards ``mean``: alpha 0 leaves it, alpha 1 gives the mean."""
    return F.zip_with(_c(p), _c(mean), lambda x, m: x + F.lit(alpha) * (m - x))


def unshrink(s: Column | str, mean: Column | str, alpha: float) -> Column:
    """The inverse of ``shrink``; the mean itself where alpha is 1."""
    if abs(alpha - 1.0) < EPS:
        return _c(mean)
    return F.zip_with(_c(s), _c(mean), lambda x, m: (x - F.lit(alpha) * m) / F.lit(1.0 - alpha))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def center_normalize(p: Column | str) -> Column:
    """Centred to mean 0 and scaled to length 1; all zeros where the centred length is below EPS.

    The Pearson distance of two vectors is 1 minus the dot product of these forms.
    """
    p = _c(p)
    divided = lambda c: let(F.sqrt(total(F.transform(c, lambda x: x * x))), lambda n: F.transform(c, lambda x: F.when(n < EPS, F.lit(0.0)).otherwise(x / n)))
    return let(total(p) / F.size(p), lambda m: let(F.transform(p, lambda x: x - m), divided))


def pearson_lowdim(p: Column | str, q: Column | str) -> Column:
    """The stand-in for vectors of one component: relative distance, at most 2."""
    bound = F.greatest(norm(p), norm(q), F.lit(EPS))
    return F.least(euclidean(p, q) / bound, F.lit(2.0))


def pearson(p: Column | str, q: Column | str) -> Column:
    """1 minus correlation, in [0, 2]; 1 where a vector has no variance; ``pearson_lowdim`` below two components."""
    p, q = _c(p), _c(q)
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(center_normalize(p), center_normalize(q))))
    return F.when((F.size(p) < 2) | (F.size(p) != F.size(q)), pearson_lowdim(p, q)).otherwise(F.lit(1.0) - corr)


def distance(p: Column | str, q: Column | str, metric: str, d: int | None = None) -> Column:
    if metric == "euclidean":
        return euclidean(p, q, d)
    if metric == "pearson":
        return pearson(p, q)
    raise ValueError(f"metric must be euclidean or pearson, not {metric!r}")


def to_set(p: Column | str, members: Column | str, metric: str = "pearson") -> Column:
    """The least distance from ``p`` to an array of vectors; infinite if that is empty."""
    return F.coalesce(F.array_min(F.transform(_c(members), lambda r: distance(p, r, metric))), F.lit(INF))


def register_sql(spark: SparkSession) -> None:
    """Catalyst-inlined SQL functions ``euclidean_distance`` and ``pearson_distance`` for SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION euclidean_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "CASE WHEN size(a) <> size(b) THEN double('infinity') ELSE sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION unit_form(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN "
        "transform(transform(a, x -> x - aggregate(a, 0D, (s, y) -> s + y) / size(a)), x -> CASE WHEN "
        f"sqrt(aggregate(a, 0D, (s, y) -> s + power(y - aggregate(a, 0D, (t, z) -> t + z) / size(a), 2))) < {EPS}D THEN 0D ELSE x / "
        "sqrt(aggregate(a, 0D, (s, y) -> s + power(y - aggregate(a, 0D, (t, z) -> t + z) / size(a), 2))) END)"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION pearson_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        f"CASE WHEN size(a) < 2 OR size(a) <> size(b) THEN least(euclidean_distance(a, b) / greatest(vector_norm(a), vector_norm(b), {EPS}D), 2D) "
        "ELSE 1D - greatest(-1D, least(1D, aggregate(zip_with(unit_form(a), unit_form(b), (x, y) -> x * y), 0D, (s, x) -> s + x))) END"
    )
