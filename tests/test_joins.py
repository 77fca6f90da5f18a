import datetime

import pytest
from pyspark.sql import functions as F

from tabkit.operators import joins as J


def test_natural_join(spark, rows_of):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id int, k string, v int")
    b = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.7)], "k string, id int, w double")
    assert rows_of(J.natural_join(a, b), "id", "k", "v", "w") == [(1, "x", 5, 0.5)]
    with pytest.raises(ValueError):
        J.natural_join(a, b.select("w"))


def test_combine_first(spark, rows_of):
    a = spark.createDataFrame([(1, 10, None), (2, None, 5)], "id int, v int, only_a int")
    b = spark.createDataFrame([(2, 20, 7), (3, 30, 8)], "id int, v int, only_b int")
    out = J.combine_first(a, b, ["id"])
    assert rows_of(out, "id", "v", "only_a", "only_b") == [(1, 10, None, None), (2, 20, 5, 7), (3, 30, None, 8)]


def test_append_columns(spark, rows_of):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    b = spark.createDataFrame([(2, 5), (3, 6)], "id int, w int")
    assert rows_of(J.append_columns(a, b, ["id"])) == [(1, 10, None), (2, 20, 5), (3, None, 6)]
    assert rows_of(J.append_columns(a, b, ["id"], assign=True)) == [(1, 10, None), (2, 20, 5)]


def test_key_mismatch(spark, rows_of):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1,), (3,)], "id int")
    assert rows_of(J.key_mismatch(a, b, ["id"])) == [(2, "left"), (3, "right")]
    with pytest.raises(ValueError, match="2.*3"):
        J.assert_same_keys(a, b, ["id"])
    J.assert_same_keys(a, a, ["id"])
    with pytest.raises(ValueError, match="counts"):
        J.assert_same_keys(a, a.union(a), ["id"])


def days(*offsets):
    return [datetime.date(2000, 1, 1) + datetime.timedelta(days=d) for d in offsets]


def test_date_lags(spark):
    d = days(0, 365, 370, 365)
    rows = [("a", d[0], 1), ("a", d[1], 2), ("a", d[2], 3), ("b", d[3], 9)]
    df = spark.createDataFrame(rows, "e string, date date, v int")
    out = {(r["e"], r["date"]): r["lag"] for r in J.date_lags(df, "date", "v", {"lag": 365}, ["e"]).collect()}
    assert out == {("a", d[0]): None, ("a", d[1]): 1, ("a", d[2]): None, ("b", d[3]): None}
    across = J.date_lags(df, "date", "v", {"lag": 365}, [])
    assert {(r["e"], r["date"]): r["lag"] for r in across.collect()}[("b", d[3])] == 1


def test_date_lags_on_a_hot_date(spark):
    d = days(0, 10)
    df = spark.createDataFrame([("a", d[0], i, i) for i in range(100)] + [("a", d[1], 7, 200)], "e string, date date, v int, i int")
    out = J.date_lags(df.withColumn("v", F.when(F.col("i") == 99, 5).otherwise(F.col("v"))), "date", "v", {"lag": 10}, ["e"], "i")
    assert out.count() == 101
    assert out.filter(F.col("date") == d[1]).first()["lag"] == 5


def test_keys_repeated_differently_are_reported(spark):
    left, right = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([1, 1, 2], [1, 2, 2]))
    with pytest.raises(ValueError, match="row counts differ"):
        J.assert_same_keys(left, right, ["k"])


def test_null_keys_match_null_keys(spark):
    left, right = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([None, 1], [1, None]))
    J.assert_same_keys(left, right, ["k"])
    assert J.key_mismatch(left, right, ["k"]).count() == 0


def test_equal_keys_are_settled_without_a_shuffle(spark, monkeypatch):
    rows = [(None, 1), (1, None), (2, 2), (2, 2), (None, None)]
    frame = lambda data: spark.createDataFrame(data, "a int, b int")
    left, right = frame(rows), frame(rows[::-1])
    assert J.key_fingerprint(left, ["a", "b"]) == J.key_fingerprint(right, ["a", "b"])
    for other in ([(1, None), (1, None), *rows[2:]], rows[:-1], [*rows[:3], (2, 3), rows[4]]):
        assert J.key_fingerprint(left, ["a", "b"]) != J.key_fingerprint(frame(other), ["a", "b"])
    assert J.key_fingerprint(frame([]), ["a", "b"]) == J.key_fingerprint(frame([]), ["a", "b"])
    monkeypatch.setattr(J, "_key_counts", lambda *_: pytest.fail("keys were compared one by one"))
    J.assert_same_keys(left, right, ["a", "b"])


def test_keys_of_other_types_are_compared_by_value(spark):
    J.assert_same_keys(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (1,)], "k long"), ["k"])
