import numpy as np
from pyspark.sql import functions as F

from loam.functions.arrays import budget_breaks, interpolated_percentile, spaced
from loam.functions.vectors import cosine, odd_window, savgol, savgol_kernel
from loam.operators import signal


def test_kernels():
    assert np.allclose(savgol_kernel(5, 2, 0), np.array([-3, 12, 17, 12, -3]) / 35)
    assert np.allclose(savgol_kernel(11, 3, 2), np.array([15, 6, -1, -6, -9, -10, -9, -6, -1, 6, 15]) / 429)
    assert savgol_kernel(4, 2, 0) is None and savgol_kernel(3, 3, 0) is None


def one(spark, expr, **arrays):
    schema = ", ".join(f"{k} array<double>" for k in arrays)
    return spark.createDataFrame([tuple(arrays.values())], schema).select(expr.alias("x")).first().x


def test_filter_follows_a_polynomial(spark):
    got = one(spark, savgol(F.col("a"), F.lit(5), 2, 0, 5), a=[float(i) for i in range(1, 10)])
    assert np.allclose(got, range(1, 10), atol=0.5)
    assert one(spark, savgol(F.col("a"), F.lit(4), 2, 0, 5), a=[1.0, 2.0]) is None


def test_minima(spark):
    got = one(spark, signal.minima(F.col("a"), 5, 2), a=[((i - 10) / 3) ** 2 for i in range(20)])
    assert any(abs(i - 10) <= 2 for i in got)
    assert one(spark, signal.minima(F.col("a"), 11, 3), a=[1.0, 0.0, 1.0]) == []


def test_percentile_and_spacing(spark):
    values = [5.0, 1.0, 3.0, 2.0, 4.0]
    assert [one(spark, interpolated_percentile(F.col("a"), p), a=values) for p in (0, 0.5, 1)] == [1, 3, 5]
    df = spark.createDataFrame([([1, 2, 4, 5, 9],)], "a array<int>")
    assert df.select(spaced(F.col("a"), 2).alias("x")).first().x == [1, 4, 9]


def test_cross_similarity(spark):
    df = spark.createDataFrame([("d", 0, [1.0, 0.0, 0.0]), ("d", 1, [1.0, 0.0, 0.0]), ("d", 2, [0.0, 1.0, 0.0]), ("z", 0, [0.0]), ("z", 1, [0.0])], "doc string, i int, embedding array<double>")
    got = {(r.doc, r.i): r.sim for r in signal.cross_similarity(df.withColumnRenamed("i", "o"), "doc", "o").collect()}
    assert got == {("d", 0): 0.5, ("d", 1): 0.5, ("z", 0): 0.0}


def test_odd_window(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (5,), (30,)], "n int")
    assert [r.x for r in df.select(odd_window(11, F.col("n")).alias("x")).collect()] == [1, 2, 3, 5, 11]


def test_cosine_of_nothing(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None


def test_budget_breaks(spark):
    df = spark.createDataFrame([([5, 5, 5, 1], [False, False, True]), ([7], [])], "t array<int>, b array<boolean>")
    got = [r.x for r in df.select(budget_breaks(F.col("t"), F.col("b"), 10).alias("x")).collect()]
    assert got == [[False, True, True], []]
    assert [r.x for r in df.select(budget_breaks(F.col("t"), F.col("b"), 0).alias("x")).collect()] == [[False, False, True], []]
