"""Boosted models trained inside groups: against hand-worked cases, a loop over entities, and the distributed fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.operators import grouped as G


def brute_stump(x, y):
    """Squared error of the best single cut over all features and both sides of the missing."""
    best = ((y - y.mean()) ** 2).sum()
    for j in range(x.shape[1]):
        for cut in np.unique(x[~np.isnan(x[:, j]), j])[:-1]:
            for missing_left in (True, False):
                left = np.where(np.isnan(x[:, j]), missing_left, x[:, j] <= cut)
                parts = [y[left], y[~left]]
                if all(len(p) for p in parts):
                    best = min(best, sum(((p - p.mean()) ** 2).sum() for p in parts))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_one_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, (40, 3)).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 1], nan=9.0) + rng.normal(size=40)
    model = G.boost(x, y, rounds=1, rate=1.0, depth=1)
    assert ((y - G.predict(model, x, 1)) ** 2).sum() == pytest.approx(brute_stump(x, y))


def test_group_means_by_hand():
    x, y = np.array([[0.0], [0.0], [1.0], [1.0], [1.0]]), np.array([1.0, 3.0, 10.0, 20.0, 30.0])
    assert G.predict(G.boost(x, y, 1, 1.0, 1), x, 1) == pytest.approx([2, 2, 20, 20, 20])
    assert G.predict(G.boost(x, y, 400, 0.1, 3), x, 3) == pytest.approx([2, 2, 20, 20, 20])
    constant = G.boost(np.full((4, 2), 7.0), np.array([1.0, 2.0, 3.0, 6.0]), 3, 0.5, 2)
    assert set(constant["which"]) == {-1} and G.predict(constant, np.array([[1.0, np.nan]]), 2) == pytest.approx([3.0])
    empty = np.full((3, 1), np.nan)
    assert G.predict(G.boost(empty, np.array([1.0, 1.0, 4.0]), 2, 0.5, 2), empty, 2) == pytest.approx([2, 2, 2])


def entities(spark, n, per=6):
    rng = np.random.default_rng(2)
    rows = [(e, i, float(rng.uniform()), None if rng.random() < 0.2 else float(rng.integers(4)), float((e or 0) % 7 + rng.normal())) for e in [*range(n), None] for i in range(per)]
    return spark.createDataFrame(rows, "e long, i int, a double, b double, y double")


def test_many_entities_in_one_job_equal_the_loop(spark):
    df = entities(spark, 10_000)
    model = G.fit_groups(df, "e", ["a", "b"], "y", rounds=3, rate=0.5, depth=2)
    assert model.models.count() == 10_001 and model.large == {}
    scored = model.transform(df)
    by_row = {(r["e"], r["i"]): r["prediction"] for r in scored.collect()}
    assert scored.columns == [*df.columns, "prediction"] and len(by_row) == 60_006
    for e in (0, 17, 4321, 9999, None):
        rows = df.filter(F.col("e").eqNullSafe(F.lit(e))).toPandas().sort_values("i")
        alone = G.boost(rows[["a", "b"]].to_numpy(float), rows["y"].to_numpy(), 3, 0.5, 2)
        want = G.predict(alone, rows[["a", "b"]].to_numpy(float), 2)
        assert [by_row[e, i] for i in range(6)] == want.tolist()


def test_large_entities_are_fitted_across_the_cluster(spark):
    df = entities(spark, 3, 30).unionByName(entities(spark, 1, 200).filter("e is not null").withColumn("e", F.lit(50).cast("long")))
    model = G.fit_groups(df.withColumn("a", F.col("a") + F.col("y")), "e", ["a", "b"], "y", rounds=5, rate=0.5, depth=2, group_rows=100)
    assert list(model.large) == [50] and model.models.count() == 4
    scored = model.transform(df.withColumn("a", F.col("a") + F.col("y")))
    assert scored.count() == df.count()
    left = scored.filter("e = 50").agg(F.corr("prediction", "y")).first()[0]
    assert left > 0.9


def test_an_entity_with_many_rows_to_score_is_dealt_to_several_tasks(spark):
    df = entities(spark, 4, 40)
    model = G.fit_groups(df, "e", ["a", "b"], "y", rounds=3, rate=0.5)
    want = {tuple(r) for r in model.transform(df).collect()}
    model.group_rows = 7
    found = model.transform(df).collect()
    assert {tuple(r) for r in found} == want and len(found) == 200


def test_entities_of_awkward_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0), ("b", None, None), ("c", 3.0, 5.0)], "e string, x double, y double")
    model = G.fit_groups(df, "e", ["x"], "y", rounds=2)
    got = {(r["e"], r["x"]): r["prediction"] for r in model.transform(df.withColumn("prediction2", F.lit(1))).collect()}
    assert got == {("a", 1.0): 2.0, ("a", None): 2.0, ("c", 3.0): 5.0}
    assert G.fit_groups(df.limit(0), "e", ["x"], "y").transform(df).count() == 0
