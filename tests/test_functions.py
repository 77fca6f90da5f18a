import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tabkit.functions import scalars as S
from tabkit.operators import columns as C


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_yes_no(spark):
    df = column(spark, [0.0, 1.0, None, 7.0])
    assert apply(df, S.yes_no(F.col("x"))) == ["No", "Yes", "No response", "No response"]


def test_clip_upper_sends_null_to_the_cut(spark):
    assert apply(column(spark, [10, 35, 80, None], "int"), S.clip_upper(F.col("x"), 35)) == [10, 35, 35, 35]


def test_keep_or(spark):
    df = column(spark, ["s", "t", "j", None], "string")
    assert apply(df, S.keep_or(F.col("x"), ["s", "t"])) == ["s", "t", "o", "o"]


def test_indicator_and_below(spark):
    df = column(spark, [3, 4, None], "int")
    assert apply(df, S.indicator(F.col("x"), 4)) == [0, 1, 0]
    assert apply(df, S.below(F.col("x"), 4)) == [1, 0, 0]


def test_recode(spark):
    df = column(spark, [0.0, 1.0, 9.0, None])
    assert apply(df, S.recode(F.col("x"), {0.0: 1, 1.0: 5})) == [1, 5, None, None]
    assert apply(df, S.recode(F.col("x"), {0.0: "a", 1.0: "b"}, "other")) == ["a", "b", "other", "other"]


def test_replace_sentinel(spark):
    df = column(spark, [995, 10, None], "int")
    assert apply(df, S.replace_sentinel(F.col("x"), 995)) == [None, 10, None]
    assert apply(df, S.replace_sentinel(F.col("x"), 995, F.lit(15))) == [15, 10, None]


def test_season_and_date_parts(spark):
    df = column(spark, [f"2001-{m:02d}-15" for m in (12, 1, 2, 3, 11)], "string")
    df = df.withColumn("x", S.parse_date(F.col("x")))
    assert apply(df, S.season(F.col("x"))) == [1, 1, 1, 2, 4]
    first = df.select(*[c.alias(n) for n, c in S.date_parts(F.col("x")).items()]).first()
    assert first.asDict() == {"year": 2001, "month": 12, "day": 15, "day_of_year": 349, "quarter": 4, "season": 1}
    assert str(apply(df, S.days_before(F.col("x"), 365))[0]) == "2000-12-15"


def test_cyclic(spark):
    out = column(spark, [3], "int").select(*[c.alias(n) for n, c in S.cyclic("m", F.col("x"), 12).items()]).first()
    assert out["m_sin"] == pytest.approx(1.0) and out["m_cos"] == pytest.approx(0.0, abs=1e-12)


def test_transforms_guard_their_domain(spark):
    df = column(spark, [-4.0, 0.0, 4.0, None])
    assert apply(df, S.sqrt_abs(F.col("x"))) == [2.0, 0.0, 2.0, None]
    assert apply(df, S.reciprocal(F.col("x"))) == [-0.25, None, 0.25, None]
    assert apply(df, S.log_positive(F.col("x"))) == [None, None, math.log(4), None]
    found = {n: apply(df, c) for n, c in S.skew_candidates(F.col("x")).items()}
    assert found["exponential"] == [None, 0.0, pytest.approx(4 ** (1 / 1.2)), None]
    assert found["sqroot"] == [None, 0.0, 2.0, None]


def test_rounding(spark):
    df = column(spark, [25.0, 35.0, -2.7])
    assert apply(df, S.round_half_even(F.col("x"), -1)) == [20.0, 40.0, -0.0]
    assert apply(df, S.truncate(F.col("x"))) == [25, 35, -2]


def test_log_grid():
    assert S.log_grid(-1, 1, 3) == pytest.approx([0.1, 1.0, 10.0])
    assert len(S.log_grid(-1, 1, 10)) == 10


def test_inverse_normal(spark):
    p = [1e-14, 1e-9, 1e-4, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9]
    want = [NormalDist().inv_cdf(x) for x in p]
    assert apply(column(spark, p), S.inverse_normal(F.col("x"))) == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_column_lists(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "id int, `temp max` double, city string")
    assert C.columns_containing(df, "temp", "ci") == ["temp max", "city"]
    assert C.columns_except(df, ["id"]) == ["city", "temp max"]
    assert C.project(df, ["temp max"]).columns == ["temp max"]
    assert C.apply_to(df, ["temp max"], S.kelvin).first()["temp max"] == pytest.approx(275.15)
    assert C.rename(df, {"id": "key"}).columns == ["key", "temp max", "city"]
    assert C.drop_columns(df, ["id"]).columns == ["temp max", "city"]


def test_orders(spark):
    df = spark.createDataFrame([("low", 1), ("high", None), ("mid", 3), (None, 2)], "size string, n int")
    by_size = [r["size"] for r in C.sort_by_category(df, "size", ["low", "mid", "high"]).collect()]
    assert by_size == ["low", "mid", "high", None]
    assert [r["n"] for r in C.sort_descending(df, "n").collect()] == [3, 2, 1, None]
    assert [r["n"] for r in C.first_rows(df.dropna(subset=["n"]), 2, "n").collect()] == [1, 2]


def test_largest_errors(spark):
    df = spark.createDataFrame([(1, 10, 12), (2, 10, 3), (3, None, 3), (4, 5, 5)], "id int, p int, y int")
    assert [(r["id"], r["abs_error"]) for r in C.largest_errors(df, "p", "y", 2, "id").collect()] == [(2, 7), (1, 2)]


def test_stack_tables_matches_by_name(spark, rows_of):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert rows_of(C.stack_tables([a, b]), "n", "s") == [(1, "x"), (2, "y")]
