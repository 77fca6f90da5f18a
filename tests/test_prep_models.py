import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabkit.catalog import models
from tabkit.operators import evaluate as E
from tabkit.operators import explain as X
from tabkit.operators import prep as R
from tabkit.operators import score as Z
from tabkit.operators import split as L
from tabkit.operators import train as T
from tabkit.sources import tables as IO


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def frame(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")


def test_standard_scale(spark):
    df = frame(spark, [1.0, 3.0, None])
    assert column(R.StandardScale(["x"]).fit(df).transform(df), "x") == [-1.0, 1.0, None]
    assert column(R.StandardScale(["x"], with_mean=False).fit(df).transform(df), "x") == [1.0, 3.0, None]
    flat = frame(spark, [5.0, 5.0])
    assert column(R.StandardScale(["x"]).fit(flat).transform(flat), "x") == [0.0, 0.0]


def test_min_max_scale(spark):
    df = frame(spark, [2.0, 4.0, 3.0, None])
    assert column(R.MinMaxScale(["x"]).fit(df).transform(df), "x") == [0.0, 1.0, 0.5, None]
    flat = frame(spark, [5.0, 5.0])
    assert column(R.MinMaxScale(["x"]).fit(flat).transform(flat), "x") == [0.0, 0.0]


def test_imputers(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 10.0, None])
    assert column(R.MedianImputer(["x"]).fit(df).transform(df), "x")[-1] == 2.5
    assert column(R.NullFlags(["x"]).fit(df).transform(df), "x_was_null") == [0, 0, 0, 0, 1]
    unknown = frame(spark, [None, None])
    assert column(R.MedianImputer(["x"]).fit(unknown).transform(unknown), "x") == [0.0, 0.0]
    text = frame(spark, ["b", "a", "a", "b", None], "string")
    assert column(R.FrequentImputer(["x"]).fit(text).transform(text), "x")[-1] == "a"


def test_one_hot_unknown_is_all_zero(spark):
    model = Pipeline(stages=R.one_hot_stages(["x"])).fit(frame(spark, ["c", "a", "b"], "string"))
    out = model.transform(frame(spark, ["a", "zz", None], "string"))
    vectors = column(out.withColumn("v", vector_to_array("x_onehot")), "v")
    assert vectors == [[1, 0, 0], [0, 0, 0], [0, 0, 0]]


def test_binary_one_hot(spark):
    df = frame(spark, ["Own", "Rent", "Own"], "string")
    assert column(R.BinaryOneHot(["x"]).fit(df).transform(df), "x") == [0.0, 1.0, 0.0]
    other = frame(spark, ["Boat"], "string")
    with pytest.raises(Exception, match="unknown category"):
        R.BinaryOneHot(["x"]).fit(df).transform(other).collect()
    assert column(R.BinaryOneHot(["x"], ignore_unknown=True).fit(df).transform(other), "x") == [0.0]
    with pytest.raises(ValueError, match="two categories"):
        R.BinaryOneHot(["x"]).fit(frame(spark, ["a", "b", "c"], "string"))


def people(spark, n=60):
    df = spark.range(n).withColumnRenamed("id", "i")
    return df.select(
        "i",
        F.when(F.col("i") % 7 != 0, F.col("i").cast("double")).alias("age"),
        F.when(F.col("i") % 5 != 0, F.when(F.col("i") % 2 == 0, "a").otherwise("b")).alias("kind"),
        F.when(F.col("i") % 3 == 0, "x").otherwise("y").alias("side"),
        (F.col("i") > n / 2).cast("int").alias("late"),
        (F.col("i") % 3 == 0).cast("int").alias("third"),
    )


ROLES = R.Roles(numeric=["age"], categorical=["kind"], binary=["side"])


def test_column_bundle_names_and_saving(spark, tmp_path):
    df = people(spark)
    model = R.column_bundle(ROLES).fit(df)
    out = model.transform(df)
    assert R.feature_names(out) == ["age", "kind_a", "kind_b", "side_flag"]
    IO.save_model(model, str(tmp_path / "m"))
    again = IO.load_model(str(tmp_path / "m")).transform(df)
    assert column(again, "features") == column(out, "features")


def test_robust_scale(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 9.0, None])
    assert column(R.RobustScale(["x"]).fit(df).transform(df), "x") == [-1.0, -0.5, 0.0, 0.5, 3.0, None]
    flat = frame(spark, [5.0, 5.0])
    assert column(R.RobustScale(["x"]).fit(flat).transform(flat), "x") == [0.0, 0.0]


def test_box_cox(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(loc=5, size=400) * 0.5 + 1) ** 2  # a square root makes it normal
    df = frame(spark, [float(v) for v in x] + [-1.0, None])
    fitted = R.BoxCox(["x"]).fit(df)
    exponent = fitted.getOrDefault("state")["x"]
    fine = np.arange(-2, 2, 0.001)
    fine = fine[np.abs(fine) > 1e-9]
    likelihood = [(e - 1) * np.log(x).sum() - len(x) / 2 * np.log(((x**e - 1) / e).var()) for e in fine]
    assert exponent == pytest.approx(fine[int(np.argmax(likelihood))], abs=2e-3)
    out = column(fitted.transform(df), "x")
    assert out[-2:] == [None, None] and out[0] == pytest.approx((x[0] ** exponent - 1) / exponent)


def newton(x, y, c):
    """Minimum of |w|^2 / 2 + c * logistic loss, intercept free."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve(ridge + c * (x1 * (p * (1 - p))[:, None]).T @ x1, ridge @ w + c * x1.T @ (p - y))
        w -= step
    return w


def test_logistic_penalty_is_on_the_summed_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    chain = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), *T.logistic_stages(["y"], 80, c=0.5)]
    fitted = Pipeline(stages=chain).fit(df).stages[-1]
    assert [*fitted.coefficients.toArray(), fitted.intercept] == pytest.approx(newton(x, y, 0.5), abs=1e-4)


def test_multilabel_search_and_submission(spark):
    labels = ["late", "third"]
    df = L.contiguous_folds(people(spark).orderBy(F.rand(1)).withColumn("mix", F.hash("i")), ["mix"], 2)

    def build(n_rows, c, max_iter):
        return Pipeline(stages=[R.column_bundle(ROLES), *T.logistic_stages(labels, n_rows, c, max_iter)])

    axes = {"c": [0.1, 1.0], "max_iter": [5]}
    model, best, results = T.random_search(df, build, axes, E.MacroAucEvaluator(labels).scores, "roc_auc", "fold", 2, draws=5)
    assert len(results) == 2 and best["c"] in (0.1, 1.0)
    assert set(results[0]) == {"c", "max_iter", "roc_auc", "accuracy", "precision_micro", "recall_micro"}
    assert max(r["roc_auc"] for r in results) > 0.9
    scored = Z.score_probabilities(model, df, ["i"], labels)
    template = df.select("i", F.lit(0.5).alias("late"), F.lit(0.5).alias("third"))
    out = Z.submission(scored, template, ["i"])
    assert out.columns == ["i", "late", "third"] and out.count() == 60
    with pytest.raises(ValueError):
        Z.submission(scored, template.filter("i > 3"), ["i"])


class CountedScale(R.StandardScale):
    """Notes every fit of the preparation."""

    fits: list[int] = []

    def _learn(self, df):
        CountedScale.fits.append(df.count())
        return super()._learn(df)


@pytest.mark.parametrize("draws", [2, 5])
def test_search_prepares_once_per_fold(spark, draws):
    df = L.contiguous_folds(people(spark).withColumn("mix", F.hash("i")), ["mix"], 3)

    def build(n_rows, c):
        bundle = R.column_bundle(R.Roles(numeric=["age"], categorical=["kind"]), [CountedScale, R.MedianImputer])
        return Pipeline(stages=[bundle, *T.logistic_stages(["late"], n_rows, c, 5)])

    CountedScale.fits.clear()
    scores = lambda rows: {"mean": rows.agg(F.avg("late_prediction")).first()[0], "n": float(rows.count())}
    model, _, results = T.random_search(df, build, {"c": [0.01, 0.1, 1.0, 5.0, 10.0]}, scores, "mean", "fold", 3, draws=draws)
    assert sorted(CountedScale.fits) == [40, 40, 40, 60] and len(results) == draws
    # the same numbers as when every setting prepares for itself
    for one in results:
        alone = []
        for i in range(3):
            fitted = build(40, one["c"]).fit(df.filter(F.col("fold") != i))
            alone.append(scores(fitted.transform(df.filter(F.col("fold") == i)))["mean"])
        assert one["mean"] == pytest.approx(sum(alone) / 3)
    assert len(model.transform(df).select("late_prediction").collect()) == 60


def test_shared_prefix_stops_at_the_first_difference():
    a = [R.StandardScale(["x"]), R.MedianImputer(["x"]), T.boosted_regressor("y", rounds=3)]
    b = [R.StandardScale(["x"]), R.MedianImputer(["x"]), T.boosted_regressor("y", rounds=4)]
    assert T.shared_prefix([a, b]) == 2 and T.shared_prefix([a, a]) == 2
    assert T.shared_prefix([a, [R.StandardScale(["z"]), *b[1:]]]) == 0
    unnamed = [[VectorAssembler(inputCols=["x"]), a[2]], [VectorAssembler(inputCols=["x"]), b[2]]]
    assert T.shared_prefix(unnamed) == 0


def regression(spark, n=120):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = 10 * a + b + rng.normal(scale=0.01, size=n)
    rows = [(i, float(a[i]), float(b[i]), 1.0, float(y[i]), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, flat double, y double, fold int")


def boosted(df, features):
    stages = [VectorAssembler(inputCols=features, outputCol="features"), T.boosted_regressor("y", rounds=3, rate=0.5, depth=3)]
    return T.fit_kept(Pipeline(stages=stages), df)


def test_grid_search_and_permutation(spark):
    df = regression(spark)
    tree = T.boosted_regressor("y", rounds=2, depth=2)
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="features"), tree]
    maps = T.param_maps(tree, T.grid(maxDepth=[1, 3]))
    found = T.grid_search(df, stages, maps, RegressionEvaluator(labelCol="y", metricName="r2"), "fold", 2)
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] > found.avgMetrics[0]


@pytest.mark.parametrize("limit", [None, 25])
def test_permutation_importance(spark, limit):
    df = regression(spark)
    model = boosted(df, ["a", "b", "flat"])
    out = {r["feature"]: r for r in X.permutation_importance(model, df, ["a", "b", "flat"], "y", "id", 3, 0, limit).collect()}
    assert out["a"]["mean"] > 0.5 and out["a"]["mean"] > 10 * abs(out["b"]["mean"])
    assert (out["flat"]["mean"], out["flat"]["std"]) == (0.0, 0.0)


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_shuffled_positions_are_a_bijection(spark, n):
    df = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "r"))
    rows = df.select("id", "r", X.shuffled_position(F.col("id"), F.col("r"), n, 5).alias("to")).collect()
    for r in range(4):
        to = [x["to"] for x in sorted(rows, key=lambda x: x["id"]) if x["r"] == r]
        assert sorted(to) == list(range(n))
        if n == 500:  # spread over the whole range, and another order in every repeat
            assert abs(np.corrcoef(range(n), to)[0, 1]) < 0.2 and sum(a == b for a, b in enumerate(to)) < 10
    assert n < 500 or len({tuple(x["to"] for x in rows if x["r"] == r) for r in range(4)}) == 4


def test_permutation_importance_against_brute_force(spark):
    df = regression(spark)
    features = ["a", "b", "flat"]
    model = boosted(df, features)
    pdf = df.toPandas().sort_values("id").reset_index(drop=True)
    at = spark.range(len(pdf)).crossJoin(spark.range(3).withColumnRenamed("id", "r"))
    sent = at.select("id", "r", X.shuffled_position(F.col("id"), F.col("r"), len(pdf), 0).alias("to")).toPandas()

    def error(frame):
        out = model.transform(spark.createDataFrame(frame)).orderBy("id").toPandas()
        return ((out["y"] - out["prediction"]) ** 2).sum()

    whole = ((pdf["y"] - pdf["y"].mean()) ** 2).sum()
    for r in X.permutation_importance(model, df, features, "y", "id", 3).collect():
        drops = []
        for i in range(3):
            one = sent[sent["r"] == i]
            changed = pdf.copy()
            changed.loc[one["to"].to_numpy(), r["feature"]] = pdf[r["feature"]].to_numpy()[one["id"].to_numpy()]
            drops.append((error(changed) - error(pdf)) / whole)
        assert r["mean"] == pytest.approx(np.mean(drops)) and r["std"] == pytest.approx(np.std(drops))


@pytest.mark.parametrize("n", [1, 7, 500])
def test_shuffled_positions_as_projections(spark, n):
    """The same bijection, in compiled methods that the JVM does compile, and under a join."""
    df = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "r"))
    slow = df.select(F.col("id").alias("was"), "r", X.shuffled_position(F.col("id"), F.col("r"), n, 5).alias("id"))
    fast = X.with_shuffled_position(df.withColumn("was", F.col("id")), "id", "r", n, 5)
    assert fast.columns == ["r", "was", "id"]
    joined = fast.join(spark.range(n), "id").select("was", "r", "id")
    assert sorted(joined.collect()) == sorted(slow.collect())


@pytest.mark.parametrize("scaled", [False, True])
def test_importance_by_cell(spark, monkeypatch, scaled):
    """Each pair of cells is predicted once; as with every row predicted for itself."""
    df = regression(spark).withColumn("k", F.col("id") % 3)
    df = df.withColumn("y", F.when(F.col("id") != 4, F.col("y") + F.col("k")))
    features = ["a", "b", "flat", "k"]
    stages = [VectorAssembler(inputCols=features, outputCol="features"), T.boosted_regressor("y", rounds=3, rate=0.5, depth=3)]
    if scaled:
        stages = [R.MinMaxScale(features), *stages]
    model = T.fit_kept(Pipeline(stages=stages), df.where("y is not null"))
    found = X.cells(model, df, features, 10**6)
    assert [bool(c) for c in found.thresholds] == [f not in X.unused_features(model, df, features) for f in features]
    found = found.predicted(found.of_rows(df, "cell"), "by_cell", "cell").select("id", "by_cell")
    assert model.transform(df).join(found, "id").where("abs(by_cell - prediction) > 1e-12").count() == 0
    out = []
    for limit in (10**6, 0):
        monkeypatch.setattr(X, "MAX_CELLS", limit)
        asked = X.permutation_importance(model, df, features, "y", "id", 3)
        assert "lambda" not in asked._jdf.queryExecution().optimizedPlan().toString()
        out.append({r["feature"]: (r["mean"], r["std"]) for r in asked.collect()})
    assert out[0].keys() == out[1].keys() == set(features)
    for f in features:
        assert out[0][f] == pytest.approx(out[1][f], rel=1e-9, abs=1e-12)


def test_cells_only_where_they_can_be_told(spark):
    df = regression(spark)
    model = boosted(df, ["a", "b"])
    assert X.cells(model, df, ["a", "b"], 1) is None
    assert X.cells(model.stages[-1], df, ["a", "b"]) is None
    skips = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="skip")
    tree = T.boosted_regressor("y", rounds=1, depth=1)
    assert X.cells(T.fit_kept(Pipeline(stages=[skips, tree]), df), df, ["a", "b"]) is None


def test_importance_moves_whole_rows_once(spark):
    df = regression(spark)
    model = boosted(df, ["a", "b", "flat"])
    assert X.unused_features(model, df, ["a", "b", "flat"]) == ["flat"]
    plans = [
        X.permutation_importance(model, df, ["a", "b", "flat"], "y", "id", n)._jdf.queryExecution().optimizedPlan().toString()
        for n in (2, 20)
    ]
    assert plans[0].count("Join ") == plans[1].count("Join ") == 1 and "Window" not in plans[1] and "Sort" not in plans[1]


def test_elimination_and_impurity(spark):
    df = regression(spark)
    model, kept, rounds = X.eliminate_features(df, ["flat", "a", "b"], "y", "id", boosted, repeats=2)
    assert "flat" not in kept and "a" in kept and ["flat"] in [r[-1:] for r in rounds]
    weights = [(r["feature"], r["importance"]) for r in X.impurity_importance(model, df).collect()]
    assert weights[0][0] == "a" and sum(w for _, w in weights) == pytest.approx(1.0)


def test_elimination_asks_one_repeat_of_what_matters(spark, monkeypatch):
    """As `permutation_importance` decides, without repeats that can't change the answer; rows are numbered once."""
    df, asked, numbered = regression(spark), [], []
    drops, number_rows = X._Numbered.drops, X.number_rows

    def counted(self, model, features, some, first, last, seed):
        asked.append((list(some), first, last))
        return drops(self, model, features, some, first, last, seed)

    monkeypatch.setattr(X._Numbered, "drops", counted)
    monkeypatch.setattr(X, "number_rows", lambda *a, **k: numbered.append(1) or number_rows(*a, **k))
    # so that features without effect are asked too
    monkeypatch.setattr(X, "unused_features", lambda *_: [])
    model, kept, rounds = X.eliminate_features(df, ["flat", "a", "b"], "y", "id", boosted, repeats=4)
    useless = [r["feature"] for r in X.permutation_importance(boosted(df, ["a", "b", "flat"]), df, ["a", "b", "flat"], "y", "id", 4).collect() if r["mean"] == r["std"] == 0]
    assert rounds[0] == sorted(useless) and "flat" in useless and len(numbered) == 2
    assert asked[0] == (["a", "b", "flat"], 0, 0) and asked[1] == (sorted(useless), 1, 3)


def test_per_entity(spark):
    df = regression(spark).withColumn("e", F.when(F.col("id") < 60, "p").otherwise("q"))
    models = T.fit_per_entity(df, "e", lambda part, _: boosted(part, ["a", "b"]))
    assert sorted(models) == ["p", "q"]
    whole = Z.score_counts(models["p"], df, ["id"])
    assert dict(whole.dtypes)["y_pred"] == "int"


def test_models_for_many_entities_and_null(spark):
    from tabkit.operators import train as T

    df = spark.createDataFrame([(i if i else None, float(i)) for i in range(102)], "e int, v double")
    models = T.fit_per_entity(df, "e", lambda rows, e: (e, rows.count()))
    assert len(models) == 102 and models[None] == (None, 1)


@pytest.mark.parametrize("cells", [0, 512])
def test_rows_sent_by_repeats_are_not_broadcast(spark, cells, monkeypatch):
    """Their number is the rows times the repeats, which Spark's guess from the files doesn't see."""
    monkeypatch.setattr(X, "MAX_CELLS", cells)
    df = regression(spark)
    found = X.permutation_importance(boosted(df, ["a", "b", "flat"]), df, ["a", "b", "flat"], "y", "id", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("most", [1, 100])
def test_customers_are_broadcast_only_if_few(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(models, "BROADCAST_ROWS", most)
    customers = [(1, 0, 1.5), (2, 1, 2.5), (None, 1, 0.5)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.createDataFrame([(7, 1, "O", 9.0, "1-URGENT"), (8, 2, "F", 8.0, None), (9, 5, "O", 7.0, "2-HIGH"), (7, None, "O", 6.0, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_date(F.lit("2024-03-01"))).write.parquet(f"{tmp_path}/orders.parquet")
    joined = models._orders(spark, str(tmp_path))
    assert sorted((r["o_orderkey"], r["c_acctbal"], r["month"]) for r in joined.collect()) == [(7, 1.5, 3), (8, 2.5, 3)]
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == (most == 100)
