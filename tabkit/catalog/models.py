"""Registered queries that train models on the given tables; no SQL counterpart."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tabkit.catalog.common import table, weekly_orders
from tabkit.functions.scalars import date_parts, log_grid
from tabkit.operators import evaluate as E
from tabkit.operators import explain as X
from tabkit.operators import grouped as G
from tabkit.operators import joins as J
from tabkit.operators import prep as R
from tabkit.operators import score as Z
from tabkit.operators import series as W
from tabkit.operators import split as L
from tabkit.operators import train as T
from tabkit.session import BROADCAST_ROWS, large_side

LABELS = ["quality", "toxic"]


def _documents(spark, d):
    docs = table(spark, d, "documents")
    text = F.col("text")
    features = docs.select(
        "doc_id", "lang", "source", "n_chars",
        F.regexp_count(text, F.lit(r"\d")).alias("n_digits"),
        F.regexp_count(text, F.lit(r"\n")).alias("n_lines"),
    )
    joined = J.natural_join(features, table(spark, d, "labels"))
    return L.stratified_split(joined, "doc_id", LABELS, 0.33, 6)


ROLES = R.Roles(numeric=["n_chars", "n_digits", "n_lines"], categorical=["lang", "source"])


def _label_pipeline(n_rows, C=1.0, max_iter=100):
    return Pipeline(stages=[R.column_bundle(ROLES), *T.logistic_stages(LABELS, n_rows, C, max_iter)])


def multilabel_logit(spark, d):
    docs = _documents(spark, d)
    train = docs.filter("role = 'train'")
    model = T.fit_kept(_label_pipeline(train.count()), train)
    return Z.score_probabilities(model, docs.filter("role = 'test'"), ["doc_id"], LABELS)


def random_search(spark, d):
    train = L.contiguous_folds(_documents(spark, d).filter("role = 'train'"), ["doc_id"], 3)
    axes = {"C": log_grid(-1, 1, 10), "max_iter": [2500, 5000]}
    scores = E.MacroAucEvaluator(LABELS).scores
    _, _, results = T.random_search(train, _label_pipeline, axes, scores, "roc_auc", "fold", 3)
    # one row per tried combination
    names = sorted(results[0])
    rows = [tuple(float(r[n]) for n in names) for r in results]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))


def _orders(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    if customers.count() > BROADCAST_ROWS:
        customers = large_side(customers)
    joined = J.join_on(table(spark, d, "orders"), customers, "o_custkey")
    return joined.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "c_acctbal", "c_nationkey", "o_orderpriority",
        F.month("o_orderdate").alias("month"),
    )


def _forest(spark, d):
    orders = StringIndexer(inputCol="o_orderstatus", outputCol="label", stringOrderType="alphabetAsc").fit(
    o := _orders(spark, d)
    ).transform(o)
    split = L.stratified_split(orders, "o_orderkey", ["o_orderstatus"], 0.33, 6)
    train = L.stratified_folds(split.filter("role = 'train'"), "label", ["o_orderkey"], 2)
    roles = R.Roles(numeric=["o_totalprice", "c_acctbal", "c_nationkey", "month"], categorical=["o_orderpriority"])
    forest = T.forest_classifier("label", n_trees=5, max_depth=4)
    stages = [R.column_bundle(roles, [lambda c: R.StandardScale(c, with_mean=False)]), forest]
    maps = T.param_maps(forest, T.grid(minInstancesPerNode=[5, 10]))
    quality = MulticlassClassificationEvaluator(metricName="accuracy")
    best = T.grid_search(train, stages, maps, quality, "fold", 2).bestModel
    return best, split.filter("role = 'test'")


def forest_grid(spark, d):
    best, test = _forest(spark, d)
    template = test.select("o_orderkey", F.lit(0).alias("prediction"))
    return Z.submission(Z.score_classes(best, test, ["o_orderkey"]), template, ["o_orderkey"])


def impurity_importance(spark, d):
    rows = _price_rows(spark, d)
    return X.impurity_importance(_price_model(rows, PRICE_FEATURES), rows)


FEATURES = ["lag1", "month", "quarter", "total_seasonal", "total_trend"]


def _weekly(spark, d):
    weeks = W.decompose(weekly_orders(spark, d), ["priority"], ["week"], ["total"], 52, max_rows=None)
    weeks = J.date_lags(weeks, "week", "total", {"lag1": 364}, ["priority"])
    parts = {k: v for k, v in date_parts(F.col("week")).items() if k in ("month", "quarter")}
    split = W.time_split(weeks.withColumns(parts), ["priority"], ["week"], 5, max_rows=None)
    return split.withColumn("row", F.concat_ws(":", "priority", F.col("week").cast("string")))


def _boosted(features, **settings):
    model = T.boosted_regressor("total", **settings)
    filled = [R.NullFlags(["lag1"]), R.MedianImputer(["lag1"])] if "lag1" in features else []
    inputs = [*features, "lag1_was_null"] if "lag1" in features else features
    return Pipeline(stages=[*filled, R.MinMaxScale(features), VectorAssembler(inputCols=inputs, outputCol="features"), model])


def gbt_series(spark, d):
    weeks = _weekly(spark, d)
    model = T.fit_kept(_boosted(FEATURES, rounds=10, rate=0.1), weeks.filter("role = 'train'"))
    scored = Z.score_counts(model, weeks.filter("role = 'test'"), ["priority", "week", "total"])
    return E.prediction_table(scored, ["priority"], "week", "y_pred", "total")


def gbt_grid(spark, d):
    weeks = _weekly(spark, d)
    train = L.contiguous_folds(weeks.filter("role = 'train'"), ["week", "priority"], 2)
    stages = _boosted(FEATURES, rounds=5).getStages()
    maps = T.param_maps(stages[-1], T.grid(stepSize=[0.05, 0.1], maxDepth=[2, 3]))
    search = T.grid_search(train, stages, maps, RegressionEvaluator(labelCol="total", metricName="r2"), "fold", 2)
    return Z.score_counts(search.bestModel, weeks.filter("role = 'test'"), ["priority", "week", "total"])


def per_entity(spark, d):
    weeks = _weekly(spark, d)
    model = G.fit_groups(weeks.filter("role = 'train'"), "priority", FEATURES, "total")
    out = Z.score_counts(model, weeks.filter("role = 'test'"), ["priority", "week", "total"])
    return E.rmse_r2(out, "total", "y_pred", ["priority"])


def _price_model(rows, features):
    tree = T.boosted_regressor("o_totalprice", rounds=3, rate=0.3, depth=2)
    return T.fit_kept(Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), tree]), rows)


def _price_rows(spark, d):
    wide = _orders(spark, d).withColumn("constant", F.lit(1.0))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("line_sum"), F.count(F.lit(1)).alias("n_lines")
    )
    return J.join_on(wide, lines, "o_orderkey").select(
        "o_orderkey", "o_totalprice", "c_acctbal", "c_nationkey", "line_sum", "n_lines", "constant"
    )


PRICE_FEATURES = ["c_acctbal", "c_nationkey", "constant", "line_sum", "n_lines"]


def perm_importance(spark, d):
    rows = _price_rows(spark, d)
    model = _price_model(rows, PRICE_FEATURES)
    return X.permutation_importance(model, rows, PRICE_FEATURES, "o_totalprice", "o_orderkey")


def recursive_elim(spark, d):
    rows = _price_rows(spark, d)
    model, kept, _ = X.eliminate_features(
        rows, PRICE_FEATURES, "o_totalprice", "o_orderkey", _price_model
    )
    return E.rmse_r2(model.transform(rows), "o_totalprice", "prediction").withColumn("features", F.lit(",".join(kept)))


QUERIES = {
    f.__name__: f
    for f in (
        multilabel_logit, random_search, forest_grid, impurity_importance, gbt_series, gbt_grid, per_entity,
        perm_importance, recursive_elim,
    )
}

ORACLE: dict[str, str] = {}
