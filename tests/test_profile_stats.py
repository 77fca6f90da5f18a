import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabkit.operators import gram
from tabkit.operators import profile as P
from tabkit.operators import stats as A
from tabkit.operators.ranks import values_at_ranks


def test_value_counts(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    assert [tuple(r) for r in P.value_counts(df, "c").collect()] == [("x", 2), ("y", 1)]
    assert {r["c"]: r["count"] for r in P.category_counts(df, "c").collect()} == {"x": 2, "y": 1, None: 1}


def test_value_shares_sum_to_hundred(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", None), (None, 1)], "c string, n int")
    out = {(r["feature"], r["value"]): r["percentage"] for r in P.value_shares(df, ["c", "n"]).collect()}
    assert out[("c", "x")] == pytest.approx(200 / 3)
    assert sum(v for (f, _), v in out.items() if f == "n") == pytest.approx(100)


def test_profile_by_target(spark, rows_of):
    rows = [(1, "a", 5, 1), (2, "a", None, 2), (3, "b", 5, 1), (None, "b", 5, 1), (5, "b", 5, None)]
    df = spark.createDataFrame(rows, "id int, f string, g int, y int")
    out = P.profile_by_target(df, ["f", "g"], "y", "id")
    assert rows_of(out, "feature", "value", "y", "count") == [
        ("f", "a", 1, 1), ("f", "a", 2, 1), ("f", "b", 1, 1), ("g", "5", 1, 2),
    ]


def test_key_counts_leaves_null_keys_out(spark, rows_of):
    df = spark.createDataFrame([("a", "m", 1), ("a", None, 2), ("a", "m", None)], "g string, s string, id int")
    assert rows_of(P.key_counts(df, ["g", "s"], "id")) == [("a", "m", 1)]


def test_diverging_layout(spark):
    df = spark.createDataFrame([("q", c, 20) for c in (-2, -1, 0, 1, 2)], "q string, code int, n int")
    out = P.diverging_layout(df, "q", "code", "n").orderBy("code").collect()
    assert [r["percentage_end"] for r in out] == pytest.approx([-30, -10, 10, 30, 50])
    assert [r["percentage_start"] for r in out] == pytest.approx([-50, -30, -10, 10, 30])


def test_diverging_layout_without_some_codes(spark):
    df = spark.createDataFrame([("q", 1, 30), ("q", 2, 10)], "q string, code int, n int")
    out = P.diverging_layout(df, "q", "code", "n").orderBy("code").collect()
    assert [r["percentage_start"] for r in out] == pytest.approx([0, 75])


def test_cross_tab(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0), ("b", None)], "g string, y int")
    out = {r["g"]: r for r in P.cross_tab(df, "g", "y", [0, 1]).collect()}
    assert (out["a"]["n_1"], out["a"]["pct_1"], out["b"]["pct_0"]) == (2, pytest.approx(200 / 3), 100.0)


def test_skewness(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 2.0), (3.0, 1.0, None), (10.0, 1.0, None)], "a double, b double, c double")
    out = {r["feature"]: r for r in A.skew_report(df, ["a", "b", "c"]).collect()}
    assert out["a"]["skewness"] == pytest.approx(1.763632614803888)
    assert out["a"]["skewness_label"] is None
    assert out["b"]["skewness"] is None and out["c"]["skewness"] is None


def test_best_transform(spark):
    df = spark.range(1, 200).select(F.exp(F.col("id") / 20.0).alias("v"))
    assert A.best_transform(A.transform_skews(df, ["v"])).first()["transform"] == "log"


def test_correlations_skip_null_pairs(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 6.0, 1.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = {(r["feature_a"], r["feature_b"]): r["corr"] for r in A.correlations(df, ["a", "b", "c"]).collect()}
    assert len(out) == 9
    assert out[("a", "b")] == pytest.approx(1.0) and out[("b", "a")] == out[("a", "b")]
    assert out[("a", "c")] == pytest.approx(-1.0)
    high = A.high_correlations(A.correlations(df, ["a", "b", "c"]))
    assert {(r["feature_a"], r["feature_b"]) for r in high.collect()} >= {("a", "b"), ("a", "c")}


def test_correlations_in_tiles(spark, monkeypatch):
    df = spark.range(20).select(*[(F.col("id") * i + F.rand(i)).alias(f"c{i}") for i in range(5)])
    whole = {tuple(r)[:2]: r["corr"] for r in A.correlations(df, df.columns).collect()}
    monkeypatch.setattr(gram, "TILE", 2)
    parts = {tuple(r)[:2]: r["corr"] for r in A.correlations(df, df.columns).collect()}
    assert parts == pytest.approx(whole) and len(parts) == 25


def test_many_columns_are_read_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(300, 500)) + 10.0 ** rng.integers(0, 6, 500)) * 10.0 ** rng.integers(-6, 7, 500)
    x[:, 1::2] += x[:, ::2] / 10
    x[rng.random(x.shape) < 0.1] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i:03}" for i in range(500)])
    pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), f"{tmp_path}/wide.parquet")  # NaN becomes null
    out = A.correlations(spark.read.parquet(f"{tmp_path}/wide.parquet"), list(frame))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = out.toPandas().pivot(index="feature_a", columns="feature_b", values="corr").to_numpy()
    np.testing.assert_allclose(got, frame.corr().to_numpy(), rtol=1e-7, atol=1e-9)


def test_correlations_of_awkward_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 5.0, None, 1.0, 1.0, 1e9), (2.0, 5.0, None, nan, inf, 1e9 + 1), (4.0, 5.0, 3.0, 2.0, 3.0, 1e9 + 3), (3.0, None, None, 5.0, 0.0, 1e9 + 2)]
    df = spark.createDataFrame(rows, "a double, same double, one double, odd double, far double, big double")
    out = {tuple(r)[:2]: r["corr"] for r in A.correlations(df, df.columns).collect()}
    assert out["a", "big"] == pytest.approx(1.0) and out["a", "a"] == 1.0
    assert out["a", "same"] is None and out["same", "same"] is None and out["a", "one"] is None
    assert math.isnan(out["a", "odd"]) and math.isnan(out["far", "a"]) and math.isnan(out["odd", "odd"])
    assert A.correlations(df.limit(0), ["a", "big"]).filter("corr is not null").isEmpty()
    assert A.target_correlations(df, ["same", "big"], "a").first()["feature"] == "big"


SPREADS = {
    "log-uniform": lambda rng, n: 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n),
    "ties": lambda rng, n: rng.integers(0, 4, n).astype(float),
    "one value": lambda rng, n: np.full(n, -2.5),
    "infinite": lambda rng, n: rng.choice([np.inf, -np.inf, 0.0, -0.0, 1.0, 1.7976931348623157e308, 5e-324, 1e-323, 1.5e-323, 2e-323], n),
    "neighbours": lambda rng, n: 1.0 + rng.integers(0, 50, n) * 2.0**-52,
    "normal": lambda rng, n: rng.normal(1e6, 1, n),
}


@pytest.mark.parametrize("spread", SPREADS)
@pytest.mark.parametrize("few", [0, 200])
def test_values_at_ranks(spark, spread, few):
    rng = np.random.default_rng(7)
    values = {k: SPREADS[spread](rng, n) for k, n in (("a", 3000), (None, 800))}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, _v double")
    ranks = {"a": [0, 1, 700, 1500, 2998, 2999], None: [0, 399, 400, 799]}
    targets = spark.createDataFrame([(k, r) for k, rs in ranks.items() for r in rs], "k string, _rank long")
    got = {(r["k"], r["_rank"]): r["_value"] for r in values_at_ranks(rows, ["k"], targets, few=few).collect()}
    assert got == {(k, r): sorted(values[k])[r] for k, rs in ranks.items() for r in rs}


def test_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.lognormal(0, 4, 5000), "small": rng.normal(size=40), None: rng.normal(size=900), "one": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "top": 1.0}
    for limit in (None, 500, 10):
        got = {r["k"]: tuple(r)[1:] for r in A.quantiles(df, ["k"], "v", asked, limit).collect()}
        assert got.keys() == groups.keys()
        for k, vs in groups.items():
            assert got[k] == pytest.approx(np.quantile(vs, list(asked.values())), rel=1e-12)
    assert A.quantiles(df.filter("v is null"), [], "v", asked, 10).count() == 0


def test_approximate_quantiles(spark):
    df = spark.range(1, 10_001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r["g"]: (r["a"], r["b"]) for r in A.approximate_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5}, 1000).collect()}
    for g, (a, b) in got.items():
        assert abs(a - 1000) <= 25 and abs(b - 5000) <= 25 and a % 2 == b % 2 == g


def test_redundant_columns():
    assert A.redundant_columns([("a", "b"), ("b", "a"), ("b", "c")]) == ["b"]
    assert A.redundant_columns([("a", "b"), ("a", "c")]) == ["b", "c"]


def test_target_correlations_are_sorted(spark):
    df = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 2.0, 2.5), (3.0, 1.0, 2.0)], "y double, down double, up double")
    assert [r["feature"] for r in A.target_correlations(df, ["down", "up"], "y").collect()] == ["up", "down"]


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", 5.0)], "g string, v double")
    out = {r["g"]: r for r in A.box_stats(df, ["g"], "v").collect()}
    assert tuple(out["a"])[1:] == (2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert tuple(out["b"])[1:] == (5.0, 5.0, 5.0, 5.0, 5.0, 0)
    assert [r["v"] for r in A.box_outliers(df, ["g"], "v").collect()] == [100.0]


def test_probability_points(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2])], "id int, v double")
    points = A.probability_points(df, ["v"], "id")
    out = [(r["ordered"], r["theoretical"]) for r in points.orderBy("ordered").collect()]
    end = 0.8195  # normal quantile of 0.5 ** (1 / 3), four digits
    assert [o for o, _ in out] == [1.0, 2.0, 3.0]
    assert [t for _, t in out] == pytest.approx([-end, 0.0, end], abs=1e-3)
    fit = A.probability_fit(points).first()
    assert fit["intercept"] == pytest.approx(2.0) and fit["r"] == pytest.approx(1.0)


def test_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "e string, v double")
    out = {r["e"]: (r["mean"], r["var"]) for r in A.mean_var(df, "v", "e").collect()}
    assert out == {"a": (2.0, 2.0), "b": (5.0, None)}
    assert tuple(A.min_max(df, ["v"]).first()) == (1.0, 5.0)


def test_phi_and_rare_flags(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 0)] * 3 + [(0, 1)], "a int, b int")
    assert A.phi(df, "a", "b").first()["phi"] == pytest.approx(9 / math.sqrt(3 * 4 * 4 * 3))
    rare = spark.range(1000).select((F.col("id") == 0).cast("int").alias("r"), (F.col("id") % 2).alias("c"))
    assert A.rare_binary_columns(rare, ["r", "c"], 0.01) == ["r"]


def test_cross_tab_counts_unlisted_values_in_the_total(spark):
    df = spark.createDataFrame([("a", v) for v in "xyzz"], "g string, y string")
    row = P.cross_tab(df, "g", "y", ["x", "y"]).first()
    assert (row["pct_x"], row["pct_y"]) == (25.0, 25.0)
