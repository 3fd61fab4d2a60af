"""Analytic values of distances and vector arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from shoal.functions import vec


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def v(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("d", [None, 2])
def test_euclidean(spark, d):
    assert value(spark, vec.euclidean(v(0, 0), v(3, 4), d)) == pytest.approx(5, abs=1e-10)
    assert value(spark, vec.sq_euclidean(v(0, 0), v(3, 4), d)) == pytest.approx(25, abs=1e-10)


def test_euclidean_five_components_and_mismatch(spark):
    assert value(spark, vec.euclidean(v(1, 2, 3, 4, 5), v(2, 3, 4, 5, 6))) == pytest.approx(math.sqrt(5), abs=1e-10)
    assert value(spark, vec.euclidean(v(1, 2), v(1, 2, 3))) == math.inf


@pytest.mark.parametrize(
    ("p", "q", "want"),
    [((1, 2, 3, 4, 5), (1, 2, 3, 4, 5), 0), ((1, 2, 3, 4, 5), (2, 4, 6, 8, 10), 0), ((1, 2, 3, 4, 5), (5, 4, 3, 2, 1), 2), ((1, -1, 1, -1), (1, 1, -1, -1), 1), ((2, 2, 2), (1, 2, 3), 1)],
)
def test_pearson(spark, p, q, want):
    assert value(spark, vec.pearson(v(*p), v(*q))) == pytest.approx(want, abs=1e-10)


def test_pearson_of_one_component_and_of_mixed_lengths(spark):
    assert value(spark, vec.pearson(v(1), v(3))) == pytest.approx(2 / 3)
    assert value(spark, vec.pearson(v(1), v(-9))) == pytest.approx(10 / 9)
    assert value(spark, vec.pearson(v(1, 2), v(1, 2, 3))) == 2.0


def test_arithmetic(spark):
    assert value(spark, vec.add(v(1, 2, 3), v(4, 5, 6))) == [5, 7, 9]
    assert value(spark, vec.sub(v(4, 5, 6), v(1, 2, 3))) == [3, 3, 3]
    assert value(spark, vec.scale(v(1, 2, 3), 2.0)) == [2, 4, 6]
    assert value(spark, vec.norm(v(3, 4))) == 5
    assert value(spark, vec.unshrink(vec.shrink(v(1, 2), v(5, 6), 0.3), v(5, 6), 0.3)) == pytest.approx([1, 2])
    assert value(spark, vec.unshrink(v(1, 2), v(5, 6), 1.0)) == [5, 6]


def test_unit_form_of_a_flat_vector_is_zero(spark):
    assert value(spark, vec.center_normalize(v(2, 2, 2))) == [0, 0, 0]


def test_sql_functions(spark):
    vec.register_sql(spark)
    r = spark.sql("SELECT euclidean_distance(array(0D, 0D), array(3D, 4D)) a, pearson_distance(array(1D, 2D, 3D), array(3D, 2D, 1D)) b").first()
    assert r["a"] == 5 and r["b"] == pytest.approx(2)


def test_sql_functions_agree_with_columns(spark):
    """Also below two components, at unequal lengths and for flat vectors."""
    vec.register_sql(spark)
    rows = [([1.0, 2.0, 4.0], [2.0, 1.0, 0.5]), ([3.0], [4.0]), ([0.0], [0.0]), ([], []), ([1.0, 2.0], [1.0, 2.0, 3.0]), ([5.0, 5.0], [1.0, 2.0]), ([1e-12, 0.0], [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = frame.select(vec.pearson("a", "b").alias("x"), F.expr("pearson_distance(a, b)").alias("y"), vec.euclidean("a", "b").alias("e"), F.expr("euclidean_distance(a, b)").alias("f")).collect()
    for r in got:
        assert r["x"] == pytest.approx(r["y"], abs=1e-12) and r["e"] == r["f"]
