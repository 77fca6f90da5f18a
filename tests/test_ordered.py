"""Order-dependent operators, with plain windows and with groups cut at a low limit."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.operators import impute as M
from tabkit.operators import series as W
from tabkit.operators import stats as A
from tabkit.operators.ordered import number_rows, running_sum, split_hot

LIMITS = [None, 30, 100_000]


@pytest.fixture(scope="module")
def frame(spark):
    """One key holds most rows and most of its rows share one time; one key is null."""
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 300), ("b", 3), ("one", 1), (None, 40)):
        for _ in range(n):
            t = 7.0 if rng.random() < 0.6 else rng.choice([rng.uniform(-5, 100), float("inf"), float("nan"), None])
            v = None if rng.random() < 0.6 else rng.uniform(0, 10)
            rows.append((key, t, len(rows), v, rng.uniform(0, 10)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, t double, id long, v double, w double")
    pdf = pd.DataFrame(rows, columns=["key", "t", "id", "v", "w"])
    pdf["key"] = pdf["key"].fillna("~")
    raw = [r[1] for r in rows]
    # nulls first, NaN last, as Spark sorts
    pdf["rank"] = [(-1 if t is None else 1 if t != t else 0) for t in raw]
    pdf["time"] = [0.0 if t is None or t != t else t for t in raw]
    pdf = pdf.sort_values(["rank", "time", "id"]).reset_index(drop=True)
    return df, pdf


def same(df, pdf, expected, column):
    got = df.toPandas().sort_values("id")[column].astype(float).to_numpy()
    want = expected.set_axis(pdf["id"]).sort_index().astype(float).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("limit", LIMITS)
def test_positions(frame, limit):
    df, pdf = frame
    same(number_rows(df, ["key"], ["t", "id"], max_rows=limit).df, pdf, pdf.groupby("key").cumcount(), "_pos")


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("keys", [["key"], []])
def test_running_sum_and_totals(frame, limit, keys):
    df, pdf = frame
    out = running_sum(df, keys, ["t", "id"], {"s": F.col("w")}, limit, {"n": F.sum("w")})
    groups = pdf.groupby("key")["w"] if keys else pdf.groupby(lambda _: 0)["w"]
    same(out, pdf, groups.cumsum(), "s")
    same(out, pdf, groups.transform("sum"), "n")


def test_cutting_bounds_every_bucket(frame):
    df, _ = frame
    laid, buckets = split_hot(df, ["key"], ["t", "id"], 30)
    assert buckets
    assert laid.groupBy("key", *buckets).count().agg(F.max("count")).first()[0] <= 40
    assert split_hot(df, ["key"], ["t", "id"], 1000)[1] == []


@pytest.mark.parametrize("limit", LIMITS)
def test_forward_fill(frame, limit):
    df, pdf = frame
    same(M.forward_fill(df, ["key"], ["t", "id"], ["v"], limit), pdf, pdf.groupby("key")["v"].ffill(), "v")


@pytest.mark.parametrize("limit", LIMITS)
def test_linear_interpolation(frame, limit):
    df, pdf = frame
    want = pdf.groupby("key")["v"].transform(lambda s: s.reset_index(drop=True).interpolate("linear").to_numpy())
    same(M.interpolate_linear(df, ["key"], ["t", "id"], ["v"], limit), pdf, want, "v")


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("period", [4, 5])
def test_moving_average(frame, limit, period):
    df, pdf = frame
    half = period // 2

    def centred(s):
        width = 2 * half + 1
        total = s.rolling(width, center=True).sum()
        if period % 2 == 0:
            total = total - (s.shift(half) + s.shift(-half)) / 2
        return total / period

    out = W.moving_average(df, ["key"], ["t", "id"], "w", period, max_rows=limit)
    same(out, pdf, pdf.groupby("key")["w"].transform(centred), "moving_average")


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles(frame, limit):
    df, pdf = frame
    asked = {"a": 0.1, "b": 0.5, "c": 0.75}
    got = A.quantiles(df, ["key"], "w", asked, limit).toPandas()
    got = got.assign(key=got["key"].fillna("~")).set_index("key").sort_index()
    want = pdf.groupby("key")["w"].quantile(list(asked.values())).unstack().sort_index()
    np.testing.assert_allclose(got[list(asked)].to_numpy(), want.to_numpy())


def test_quantiles_with_one_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 600, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    row = A.quantiles(df, [], "v", {"m": 0.5, "p": 0.9}, 50).first()
    assert (row["m"], row["p"]) == (5.0, pytest.approx(899.1))


@pytest.mark.parametrize("limit", LIMITS)
def test_monotonic(frame, limit):
    df, _ = frame
    known = df.filter(F.col("t").isNotNull() & ~F.isnan("t"))
    up = A.is_monotonic(known, "t", ["t", "id"], ["key"], limit)
    assert {r["key"]: r["monotonic"] for r in up.collect()}["hot"] is True


def test_monotonic_sees_a_fall_between_buckets(spark):
    df = spark.range(200).withColumn("v", F.when(F.col("id") < 100, 1000 + F.col("id")).otherwise(F.col("id")))
    assert A.is_monotonic(df, "v", ["id"], max_rows=10).first()["monotonic"] is False
    assert A.is_monotonic(df, "id", ["id"], max_rows=10).first()["monotonic"] is True


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "int"])
def test_order_types(spark, kind):
    start = datetime.datetime(2020, 3, 1)
    times = [start + datetime.timedelta(days=i % 60, seconds=i if kind != "date" else 0) for i in range(240)]
    rows = [("a", t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "key string, t timestamp_ntz, id long")
    df = df.withColumn("t", F.dayofyear("t") if kind == "int" else F.col("t").cast(kind))
    got = {r["id"]: r["_pos"] for r in number_rows(df, ["key"], ["t", "id"], max_rows=7).df.collect()}
    want = {r["id"]: r["_pos"] for r in number_rows(df, ["key"], ["t", "id"], max_rows=None).df.collect()}
    assert got == want


@pytest.mark.parametrize("prefix", ["", "Customer#0000000000000"])
def test_text_order(spark, prefix):
    rng = random.Random(4)
    names = [prefix + "".join(rng.choice("abz09é") for _ in range(rng.randrange(9))) for _ in range(150)]
    names = sorted(set(names)) + [None]
    df = spark.createDataFrame([("a", n) for n in names], "key string, name string").repartition(3)
    laid, buckets = split_hot(df, ["key"], ["name"], 10)
    assert laid.groupBy(*buckets).count().agg(F.max("count")).first()[0] <= 20
    got = {r["name"]: r["_pos"] for r in number_rows(df, ["key"], ["name"], max_rows=10).df.collect()}
    ranked = sorted((n for n in names if n is not None), key=lambda n: n.encode())
    assert got == {n: i for i, n in enumerate([None, *ranked])}


def test_empty_input(spark):
    df = spark.createDataFrame([], "key string, t int, v double")
    assert number_rows(df, ["key"], ["t"], max_rows=5).df.count() == 0
    assert M.forward_fill(df, ["key"], ["t"], ["v"], 5).count() == 0


def uneven(spark, kind):
    """20,000 rows of one group whose order columns are hard to cut into even pieces."""
    n, rng = 20_000, random.Random(9)
    if kind == "repeated text and id":
        rows = [("the same name" if i % 10 else f"n{i}", i) for i in range(n)]
        schema = "a string, b long"
    elif kind == "long prefix":
        rows = [("a prefix that is shared by every single row: " + f"{rng.random():.12f}", i) for i in range(n)]
        schema = "a string, b long"
    elif kind == "boolean first":
        rows = [(i % 7 == 0, rng.random()) for i in range(n)]
        schema = "a boolean, b double"
    elif kind == "beyond doubles":
        rows = [(2**60 + i, i) for i in range(n)]
        schema = "a long, b long"
    elif kind == "binary":
        rows = [(bytes([i % 3, *rng.randbytes(6)]), i) for i in range(n)]
        schema = "a binary, b long"
    else:
        rows = [(10.0 ** rng.uniform(-300, 300), i) for i in range(n)]
        schema = "a double, b long"
    rng.shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.mark.parametrize("kind", ["repeated text and id", "long prefix", "boolean first", "beyond doubles", "binary", "log-uniform"])
def test_ranges_are_even_and_rows_equal_the_plain_window(spark, kind):
    df = uneven(spark, kind)
    laid, ranges = split_hot(df, [], ["a", "b"], 1000)
    sizes = [r["count"] for r in laid.groupBy(*ranges).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 20 and max(sizes) <= 3 * 20_000 / len(sizes)
    plain = number_rows(df, [], ["a", "b"], max_rows=None).df
    assert number_rows(df, [], ["a", "b"], max_rows=1000).df.exceptAll(plain).isEmpty()


def test_sample_of_many_ranges_is_bounded(spark, monkeypatch):
    """With many ranges fewer keys are sampled for each; the layout is as good, and the session as it was."""
    from tabkit.operators import ordered

    name, seen, write = "spark.sql.execution.rangeExchange.sampleSizePerPartition", [], ordered.stable
    monkeypatch.setattr(ordered, "MAX_SAMPLE", 200)
    monkeypatch.setattr(ordered, "stable", lambda rows: seen.append(int(spark.conf.get(name))) or write(rows))
    before = spark.conf.get(name)
    df = uneven(spark, "repeated text and id")
    laid, _ = split_hot(df, [], ["a", "b"], 1000)
    assert seen == [5] and spark.conf.get(name) == before and laid.count() == 20_000
    assert number_rows(df, [], ["a", "b"], max_rows=1000).df.exceptAll(number_rows(df, [], ["a", "b"], max_rows=None).df).isEmpty()


def test_carries_are_fewer_than_ranges(spark):
    """Many small groups beside a hot one: only groups that cross a boundary need a carry."""
    df = spark.range(6000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("key"), "id", (F.col("id") % 5).alias("x"))
    laid, _ = split_hot(df, ["key"], ["id"], 500)
    n_ranges = laid.select("_range").distinct().count()
    per_group = laid.groupBy("key").agg(F.countDistinct("_range").alias("n"))
    assert per_group.agg(F.sum(F.col("n") - 1)).first()[0] < n_ranges
    got = running_sum(df, ["key"], ["id"], {"s": F.col("x")}, 500)
    assert got.exceptAll(running_sum(df, ["key"], ["id"], {"s": F.col("x")}, None)).isEmpty()


def test_running_sums_of_nulls(spark):
    df = spark.range(400).select("id", F.when(F.col("id") > 250, F.col("id")).alias("x"))
    got = running_sum(df, [], ["id"], {"s": F.col("x")}, 50)
    assert got.exceptAll(running_sum(df, [], ["id"], {"s": F.col("x")}, None)).isEmpty()
