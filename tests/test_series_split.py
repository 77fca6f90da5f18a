import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import series as W
from tabkit.operators import split as L


def ramp(spark, n, wave=(0,), key="a"):
    return spark.createDataFrame([(key, i, float(2 * i + wave[i % len(wave)])) for i in range(n)], "e string, t int, x double")


@pytest.mark.parametrize("limit", [None, 6])
@pytest.mark.parametrize(("n", "wave"), [(16, (0, 0, 0, 0)), (18, (1, -1, 2, -2)), (8, (1, -1, 2, -2))])
def test_decompose_even_period(spark, n, wave, limit):
    out = W.decompose(ramp(spark, n, wave), ["e"], ["t"], ["x"], 4, limit).orderBy("t").collect()
    assert [r["x_trend"] for r in out] == pytest.approx([2.0 * i for i in range(n)])
    assert [r["x_seasonal"] for r in out] == pytest.approx([wave[i % 4] for i in range(n)])
    assert [r["x_resid"] for r in out] == pytest.approx([0] * n, abs=1e-9)


@pytest.mark.parametrize("limit", [None, 6])
def test_decompose_odd_period(spark, limit):
    out = W.decompose(ramp(spark, 17, (3, 0, -3)), ["e"], ["t"], ["x"], 3, limit).orderBy("t").collect()
    assert [r["x_trend"] for r in out] == pytest.approx([2.0 * i for i in range(17)])
    assert [r["x_seasonal"] for r in out] == pytest.approx([(3, 0, -3)[i % 3] for i in range(17)])


def by_hand(x, p):
    """Classical decomposition step by step in numpy."""
    n, half = len(x), p // 2
    weights = np.r_[0.5, np.ones(p - 1), 0.5] / p if p % 2 == 0 else np.ones(p) / p
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(x, weights, "valid")
    front, back = half, n - 1 - half
    i = np.arange(front, min(front + p, back))
    a, b = np.polyfit(i, trend[i], 1)
    j = np.arange(max(front, back - p), back)
    c, d = np.polyfit(j, trend[j], 1)
    trend[:front] = a * np.arange(front) + b
    trend[back + 1 :] = c * np.arange(back + 1, n) + d
    means = np.array([(x - trend)[k::p].mean() for k in range(p)])
    seasonal = (means - means.mean())[np.arange(n) % p]
    return trend, seasonal, x - trend - seasonal


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("p", [7, 12])
def test_decompose_random_series(spark, p, limit):
    rng = np.random.default_rng(p)
    x, y = rng.normal(size=101).cumsum(), rng.normal(size=60)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "e string, t int, x double").repartition(5)
    out = W.decompose(df, ["e"], ["t"], ["x"], p, limit).toPandas().sort_values(["e", "t"])
    for key, values in (("a", x), ("b", y)):
        got = out[out["e"] == key][["x_trend", "x_seasonal", "x_resid"]].to_numpy().T
        np.testing.assert_allclose(got, by_hand(values, p), rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("limit", [None, 5])
def test_decompose_refuses_short_or_gappy_series(spark, limit):
    gappy = ramp(spark, 16, key="gap").withColumn("x", F.when(F.col("t") != 3, F.col("x")))
    df = ramp(spark, 7, key="short").union(gappy).union(ramp(spark, 16, key="fine"))
    out = W.decompose(df, ["e"], ["t"], ["x"], 4, limit)
    assert out.count() == 39
    assert out.filter("x_ok").select("e").distinct().collect()[0]["e"] == "fine"
    assert out.filter("not x_ok and (x_trend is not null or x_seasonal is not null)").count() == 0


def date(m, d=1):
    return datetime.date(2001, m, d)


def test_resample_month(spark):
    df = spark.createDataFrame([("a", date(1), 2), ("a", date(1, 9), 3), ("a", date(3), 4)], "e string, d date, v int")
    out = [(r["month_end"], r["v"]) for r in W.resample_month(df, ["e"], "d", "v").orderBy("month_end").collect()]
    assert out == [(date(1, 31), 5), (date(2, 28), 0), (date(3, 31), 4)]


def test_calendar_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", date(1), 20), ("a", date(1, 9), 5), ("a", date(2), 1)], "e string, d date, v int")
    out = W.calendar_table(df, ["e"], "d", "v").orderBy("month").collect()
    assert [(r["total"], r["scale_top"]) for r in out] == [(25, 20), (1, 20)]


def test_regular_grid(spark):
    df = spark.createDataFrame([("a", date(1, 1), 2), ("a", date(1, 22), 3)], "e string, d date, v int")
    out = W.regular_grid(df, ["e"], "d", "7 days", ["v"]).orderBy("d").collect()
    assert [r["v"] for r in out] == [2, 0, 0, 3]


@pytest.mark.parametrize("limit", [None, 5])
def test_time_split(spark, limit):
    out = W.time_split(ramp(spark, 12), ["e"], ["t"], 5, limit).orderBy("t").collect()
    assert [r["role"] for r in out] == ["train"] * 10 + ["test"] * 2


@pytest.mark.parametrize("limit", [None, 5])
def test_time_folds(spark, limit):
    out = W.time_folds(ramp(spark, 13), ["e"], ["t"], 5, limit)
    by_fold = {f: [] for f in range(1, 6)}
    for r in out.collect():
        by_fold[r["fold"]].append((r["t"], r["role"]))
    for f, rows in by_fold.items():
        start = 13 - (6 - f) * 2
        assert sorted(rows) == [(i, "train") for i in range(start)] + [(i, "test") for i in range(start, start + 2)]
    last = out.filter("fold = 5")
    assert W.first_test_dates(last, ["e"], "t").first()["first_test"] == 11


def strata(spark, sizes):
    rows = [(i, name) for i, name in enumerate(n for name, k in sizes.items() for n in [name] * k)]
    return spark.createDataFrame(rows, "id int, y string")


def test_stratified_split_is_exact(spark):
    df = strata(spark, {"a": 500, "b": 43, "c": 4, None: 10})
    out = L.stratified_split(df, "id", ["y"], 0.33, 6)
    counts = {(r["y"], r["role"]): r["count"] for r in out.groupBy("y", "role").count().collect()}
    assert sum(counts.values()) == 557
    n_test = sum(v for (_, role), v in counts.items() if role == "test")
    assert n_test == int(np.ceil(557 * 0.33))
    for name, n in (("a", 500), ("b", 43), ("c", 4), (None, 10)):
        assert abs(counts[(name, "train")] - n * (557 - n_test) / 557) < 1
    again = L.stratified_split(df.repartition(7), "id", ["y"], 0.33, 6)
    assert out.exceptAll(again).count() == 0
    other = L.stratified_split(df, "id", ["y"], 0.33, 7)
    assert out.exceptAll(other).count() > 0


def test_hash_split_share(spark):
    df = spark.range(5000)
    assert 0.3 < L.hash_split(df, "id", 0.33).filter("role = 'test'").count() / 5000 < 0.36


@pytest.mark.parametrize("limit", [None, 4])
def test_contiguous_folds(spark, limit):
    out = L.contiguous_folds(spark.range(11), ["id"], 3, max_rows=limit).orderBy("id").collect()
    assert [r["fold"] for r in out] == [0] * 4 + [1] * 4 + [2] * 3


def dealt(labels, k):
    """Stratified block folds: deal the class-sorted rows in turn, then cut each class into those counts."""
    order = list(dict.fromkeys(labels))
    coded = [order.index(v) for v in labels]
    ranked = sorted(coded)
    want = [[ranked[i::k].count(c) for c in range(len(order))] for i in range(k)]
    folds, seen = [], dict.fromkeys(range(len(order)), 0)
    for c in coded:
        ends = np.cumsum([want[i][c] for i in range(k)])
        folds.append(int(np.searchsorted(ends, seen[c], side="right")))
        seen[c] += 1
    return folds


@pytest.mark.parametrize("k", [2, 3, 5])
def test_stratified_folds(spark, k):
    rng = np.random.default_rng(k)
    labels = [str(v) for v in rng.choice(["z", "a", "m"], size=50, p=[0.6, 0.3, 0.1])]
    df = spark.createDataFrame(list(enumerate(labels)), "id int, y string").repartition(3)
    out = L.stratified_folds(df, "y", ["id"], k, max_rows=8).orderBy("id").collect()
    assert [r["fold"] for r in out] == dealt(labels, k)
