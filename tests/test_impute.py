import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import impute as M
from tabkit.operators import spline
from tabkit.operators.ordered import number_rows


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "e string, t int, v double")


def values(df):
    return [r["v"] for r in df.orderBy("e", "t").collect()]


def test_forward_fill_stays_in_its_entity(spark):
    df = series(spark, [None, 1.0, None, 3.0]).union(series(spark, [None, 5.0], "b"))
    assert values(M.forward_fill(df, ["e"], ["t"], ["v"])) == [None, 1.0, 1.0, 3.0, None, 5.0]


@pytest.mark.parametrize("limit", [None, 2])
def test_linear(spark, limit):
    df = series(spark, [None, 1.0, None, None, 4.0, None])
    assert values(M.interpolate_linear(df, ["e"], ["t"], ["v"], limit)) == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def not_a_knot(x, y, at):
    """Piecewise cubic through all knots, written as one dense system of its coefficients."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    r = 0

    def powers(t, d):
        return {0: [1, t, t**2, t**3], 1: [0, 1, 2 * t, 3 * t**2], 2: [0, 0, 2, 6 * t], 3: [0, 0, 0, 6]}[d]

    for i in range(n):
        for t, v in ((0, y[i]), (x[i + 1] - x[i], y[i + 1])):
            a[r, 4 * i : 4 * i + 4], b[r] = powers(t, 0), v
            r += 1
    for i in range(n - 1):
        for d in (1, 2):
            a[r, 4 * i : 4 * i + 4] = powers(x[i + 1] - x[i], d)
            a[r, 4 * i + 4 : 4 * i + 8] = [-p for p in powers(0, d)]
            r += 1
    for i in (0, n - 2):
        a[r, 4 * i : 4 * i + 4] = powers(0, 3)
        a[r, 4 * i + 4 : 4 * i + 8] = [-p for p in powers(0, 3)]
        r += 1
    c = np.linalg.solve(a, b).reshape(n, 4)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    return np.array([np.dot(c[j], powers(t - x[j], 0)) for j, t in zip(i, at)])


def gappy(n, seed):
    rng = np.random.default_rng(seed)
    known = rng.random(n) < 0.5
    known[: 3] = [False, False, True]
    return [float(v) if k else None for v, k in zip(rng.normal(size=n).cumsum(), known)]


@pytest.mark.parametrize("limit", [None, 20])
def test_cubic_against_a_dense_solve(spark, limit):
    v = gappy(120, 1)
    got = values(M.interpolate_cubic(series(spark, v), ["e"], ["t"], ["v"], limit))
    x = np.array([i for i, y in enumerate(v) if y is not None], float)
    y = np.array([y for y in v if y is not None])
    inside = np.arange(int(x[0]), int(x[-1]) + 1)
    np.testing.assert_allclose([got[i] for i in inside], not_a_knot(x, y, inside.astype(float)), rtol=1e-8, atol=1e-8)
    assert all(got[i] is None for i in range(120) if i < x[0] or i > x[-1])


def test_cubic_reproduces_a_cubic(spark):
    v = [float(i**3 - 2 * i) if i not in (2, 3, 6) else None for i in range(10)]
    got = values(M.interpolate_cubic(series(spark, v), ["e"], ["t"], ["v"]))
    assert got == pytest.approx([float(i**3 - 2 * i) for i in range(10)])


def test_cubic_needs_four_values(spark):
    assert values(M.interpolate_cubic(series(spark, [1.0, None, 2.0, 3.0]), ["e"], ["t"], ["v"])) == [1.0, None, 2.0, 3.0]


def test_spline_blocks_agree_with_one_block(spark):
    df = series(spark, gappy(900, 2))
    rows = number_rows(df, ["e"], ["t"])
    whole = {r["_pos"]: r["_m"] for r in spline.knot_curvature(rows, F.col("v"), None).collect()}
    parts = spline.knot_curvature(rows, F.col("v"), None, block_knots=50, halo_knots=64)
    parts = {r["_pos"]: r["_m"] for r in parts.collect()}
    assert parts.keys() == whole.keys()
    np.testing.assert_allclose([parts[k] for k in whole], list(whole.values()), rtol=1e-12, atol=1e-12)


def test_means(spark):
    df = series(spark, [1.0, None, 5.0]).union(series(spark, [None, 12.0], "b"))
    assert values(M.fill_mean(df, ["v"])) == [1.0, 6.0, 5.0, 6.0, 12.0]
    assert values(M.fill_mean(df, ["v"], ["e"])) == [1.0, 3.0, 5.0, 12.0, 12.0]


def test_median_and_mode(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), (None, None)], "s string, v double")
    assert M.column_medians(df, ["v"]) == {"v": 2.5}
    assert M.column_modes(df, ["s", "v"]) == {"s": "a", "v": 1.0}
    assert M.fill_mode(df, ["s"]).filter("s = 'a'").count() == 3
    assert M.fill_median(df, ["v"]).filter("v = 2.5").count() == 1


def test_constants_and_sentinels(spark):
    df = spark.createDataFrame([(-9999, None), (3, 1.0)], "a int, b double")
    assert M.column_minima(df, ["a"]).first()["a"] == -9999
    assert sorted(r["a"] or 0 for r in M.sentinel_to_null(df, ["a"], -9999).collect()) == [0, 3]
    assert M.fill_constant(df, {"b": 0.0}).agg(F.sum("b")).first()[0] == 1.0


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert M.nan_to_null(df, ["v"]).filter("v is null").count() == 2


def test_compare_fills(spark):
    out = M.compare_fills(series(spark, [1.0, None, 3.0, 4.0, 5.0]), ["e"], ["t"], "v")
    at_gap = {r["method"]: r["filled"] for r in out.filter("t = 1").collect()}
    assert at_gap == pytest.approx({"ffill": 1.0, "linear": 2.0, "cubic": 2.0, "mean": 3.25, "zero": 0.0})
    assert out.count() == 25


def test_only_blocks_with_a_gap_are_solved(spark):
    known = [float(i % 7) for i in range(200)]
    rows = M.number_rows(series(spark, [None, None, *known, None]), ["e"], ["t"])
    assert spline.knot_curvature(rows, F.col("v"), None, block_knots=50).count() == 0
    # the gap lies between the last knot of the first block and the first of the second
    rows = M.number_rows(series(spark, [*known[:50], None, *known[50:]]), ["e"], ["t"])
    assert sorted(r["_pos"] for r in spline.knot_curvature(rows, F.col("v"), None, block_knots=50).collect()) == [*range(50), *range(51, 101)]
