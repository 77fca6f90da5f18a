"""Fitting and tuning MLlib models."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import product

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import stable


@contextmanager
def kept(df: DataFrame):
    """Keep the rows in memory or on disk for the block, unless the caller already does."""
    if df.is_cached:
        yield df
        return
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def fit_kept(estimator: Estimator, df: DataFrame) -> Model:
    """Fit with the rows kept, as the stages of a pipeline read them again and again."""
    with kept(df) as rows:
        return estimator.fit(rows)


def logistic_stages(
    labels: list[str], n_rows: int, c: float = 1.0, max_iter: int = 100, features: str = "features"
) -> list[LogisticRegression]:
    """One independent L2 logistic model per 0/1 label; `c` is the inverse penalty on the summed loss."""
    return [
        LogisticRegression(
            featuresCol=features, labelCol=name, predictionCol=f"{name}_prediction",
            probabilityCol=f"{name}_probability", rawPredictionCol=f"{name}_raw",
            regParam=1.0 / (c * n_rows), elasticNetParam=0.0, standardization=False, maxIter=max_iter,
        )
        for name in labels
    ]


def forest_classifier(
    label: str, n_trees: int = 1400, min_leaf: int = 5, max_depth: int = 30, seed: int = 2018,
    features: str = "features",
) -> RandomForestClassifier:
    """Random forest on the square root of the features; MLlib stops at depth 30."""
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, numTrees=n_trees, minInstancesPerNode=min_leaf,
        maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt",
    )


def boosted_regressor(
    label: str, rounds: int = 500, rate: float = 0.05, depth: int = 3, bins: int = 32, seed: int = 0,
    features: str = "features",
) -> GBTRegressor:
    """Squared-error gradient boosting."""
    return GBTRegressor(
        featuresCol=features, labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, maxBins=bins,
        lossType="squared", seed=seed,
    )


def histogram_regressor(label: str, rounds: int = 100, rate: float = 0.04, depth: int = 3, **rest) -> GBTRegressor:
    """Gradient boosting on finely binned features."""
    return boosted_regressor(label, rounds, rate, depth, bins=255, **rest)


def grid(**axes: list) -> list[dict]:
    """All combinations of the named values."""
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def param_maps(stage: Estimator, combinations: list[dict]) -> list[dict]:
    return [{stage.getParam(name): value for name, value in one.items()} for one in combinations]


def flat_stages(estimator) -> list:
    """The stages of a pipeline, those of pipelines within it in their place."""
    if isinstance(estimator, Pipeline):
        return [s for stage in estimator.getStages() for s in flat_stages(stage)]
    return [estimator]


def _settings(stage) -> dict:
    return {p.name: value for p, value in stage._paramMap.items()}


def _named_outputs(stage) -> bool:
    """Whether the stage's output names don't hang on its own identity."""
    return all(not stage.hasParam(p) or stage.isSet(p) for p in ("outputCol", "outputCols")) or stage.hasParam("columns")


def shared_prefix(candidates: list[list]) -> int:
    """How many leading stages all candidates have in common: same kind, same settings, outputs named outright."""
    shared = 0
    for stages in zip(*candidates):
        first = stages[0]
        if not _named_outputs(first) or any(type(s) is not type(first) or _settings(s) != _settings(first) for s in stages):
            break
        shared += 1
    return min(shared, min(map(len, candidates)) - 1)


class FoldStore:
    """Per fold, the rows as the shared preparation leaves them when fitted without that fold.

    Every preparation is fitted once and its output written to the shared
    folder, where all settings tried on the fold read it: the rows are stored
    once per fold, and no setting prepares anything again.
    """

    def __init__(self, df: DataFrame, preparation: list, fold: str, folds: int, at_once: int):
        self.fold = fold

        def prepared(i: int) -> DataFrame:
            if not preparation:
                return df
            model = Pipeline(stages=preparation).fit(df.filter(F.col(fold) != i))
            return stable(model.transform(df))

        with ThreadPoolExecutor(at_once) as pool:
            self.rows = list(pool.map(prepared, range(folds)))

    def split(self, i: int) -> tuple[DataFrame, DataFrame]:
        return self.rows[i].filter(F.col(self.fold) != i), self.rows[i].filter(F.col(self.fold) == i)


def _tried(
    df: DataFrame, tails: Callable[[int, int], Estimator], settings: int, preparation: list, score: Callable, fold: str, folds: int, at_once: int
) -> list[list]:
    """Scores by setting and fold; `at_once` fits share the cluster at a time."""
    store = FoldStore(df, preparation, fold, folds, at_once)

    def one(job: tuple[int, int]):
        setting, i = job
        train, test = store.split(i)
        return score(tails(setting, i).fit(train).transform(test))

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(one, product(range(settings), range(folds))))
    return [found[s * folds : (s + 1) * folds] for s in range(settings)]


def grid_search(
    df: DataFrame, stages: list, maps: list[dict], evaluator, fold: str, folds: int, parallelism: int = 4
) -> CrossValidatorModel:
    """Try every parameter map on the given folds and refit the best on all rows.

    Stages before the first one that a map sets are fitted once per fold.
    """
    flat = flat_stages(Pipeline(stages=stages))
    owners = {p.parent for one in maps for p in one}
    shared = next((i for i, stage in enumerate(flat) if stage.uid in owners), len(flat) - 1)
    head, tail = flat[:shared], Pipeline(stages=flat[shared:])
    with kept(df) as rows:
        scores = _tried(rows, lambda s, _: tail.copy(maps[s]), len(maps), head, evaluator.evaluate, fold, folds, parallelism)
        means = [sum(one) / folds for one in scores]
        best = (max if evaluator.isLargerBetter() else min)(range(len(maps)), key=lambda s: means[s])
        model = Pipeline(stages=flat).copy(maps[best]).fit(rows)
    return CrossValidatorModel(model, avgMetrics=means)


def random_search(
    df: DataFrame,
    build: Callable[..., Estimator],
    axes: dict[str, list],
    scores: Callable[[DataFrame], dict[str, float]],
    refit: str,
    fold: str,
    folds: int,
    draws: int = 10,
    seed: int = 6,
    at_once: int = 4,
) -> tuple[PipelineModel, dict, list[dict]]:
    """Try `draws` different combinations; refit the one with the best mean of score `refit`.

    Returns the model, its parameters, and every combination's mean scores.
    `build` also gets `n_rows`, the size of the data it will be fitted on. The
    leading stages that all combinations share are fitted once per fold.
    """
    every = grid(**axes)
    chosen = random.Random(seed).sample(every, min(draws, len(every)))
    with kept(df) as df:
        sizes = {r[fold]: r["count"] for r in df.groupBy(fold).count().collect()}
        total = sum(sizes.values())
        built = [[flat_stages(build(**parameters, n_rows=total - sizes.get(i, 0))) for i in range(folds)] for parameters in chosen]
        shared = min(shared_prefix([one[i] for one in built]) for i in range(folds)) if len(chosen) > 1 else 0

        def tail(setting: int, i: int) -> Pipeline:
            return Pipeline(stages=built[setting][i][shared:])

        found = _tried(df, tail, len(chosen), built[0][0][:shared], scores, fold, folds, at_once)
        results = [
            {**parameters, **{name: sum(s[name] for s in per_fold) / folds for name in per_fold[0]}}
            for parameters, per_fold in zip(chosen, found, strict=True)
        ]
        best = max(range(len(chosen)), key=lambda i: results[i][refit])
        return build(**chosen[best], n_rows=total).fit(df), chosen[best], results


def fit_per_entity(
    df: DataFrame, entity: str, fit: Callable[[DataFrame, object], Model], at_once: int = 4
) -> dict[object, Model]:
    """One distributed fit per entity, null being one too; meant for large entities.

    The rows are computed once and written out, not once per entity. `at_once`
    fits share the cluster at a time.
    """
    held = stable(df)
    found = [r[0] for r in held.select(entity).distinct().orderBy(entity).collect()]
    with ThreadPoolExecutor(at_once) as pool:
        models = pool.map(lambda e: fit(held.filter(F.col(entity).eqNullSafe(F.lit(e))), e), found)
        return dict(zip(found, models, strict=True))
