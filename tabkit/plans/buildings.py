"""Building damage classification with a random forest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import clip_upper, indicator
from tabkit.operators import evaluate as E
from tabkit.operators import explain as X
from tabkit.operators import prep as R
from tabkit.operators import profile as P
from tabkit.operators import score as Z
from tabkit.operators import split as L
from tabkit.operators import train as T
from tabkit.operators.joins import natural_join

KEY, TARGET = "building_id", "damage_grade"

# The cuts, categories and columns the model is defined by.
AREA_CUT, HEIGHT_CUT = 35, 14
NUMERIC = ["geo_level_1_id", "geo_level_2_id", "geo_level_3_id", "area_pct_cleaned", "height_pct_cleaned"]
FLAGS = [
    "has_superstructure_mud_mortar_stone", "has_superstructure_timber", "ground_floor_type_f",
    "foundation_type_cleaned", "land_roof_type_x",
]
ROLES = R.Roles(numeric=NUMERIC, binary=FLAGS)


def clean(values: DataFrame) -> DataFrame:
    """Clip footprint and height; reduce roof, foundation and ground floor to the one telling category."""
    return values.withColumns(
        {
            "area_pct_cleaned": clip_upper(F.col("area_percentage"), AREA_CUT),
            "height_pct_cleaned": clip_upper(F.col("height_percentage"), HEIGHT_CUT),
            "land_roof_type_x": indicator(F.col("roof_type"), "x"),
            "foundation_type_cleaned": indicator(F.col("foundation_type"), "r"),
            "ground_floor_type_f": indicator(F.col("ground_floor_type"), "f"),
        }
    )


def damage_profile(values: DataFrame, labels: DataFrame, features: list[str]) -> DataFrame:
    """Buildings per feature value and damage grade, all features in one scan."""
    return P.profile_by_target(natural_join(values, labels), features, TARGET, KEY)


def split(values: DataFrame, labels: DataFrame, seed: int = 6) -> DataFrame:
    rows = clean(natural_join(values, labels)).select(KEY, TARGET, *NUMERIC, *FLAGS)
    return L.stratified_split(rows, KEY, [TARGET], 0.33, seed)


def tune(
    rows: DataFrame, n_trees: int = 1400, max_depth: int = 30, min_leaf: list[int] = (5, 10), folds: int = 2
) -> PipelineModel:
    """Grid search over the leaf size on stratified folds, refitted on all training rows."""
    train = L.stratified_folds(rows.filter(F.col("role") == "train"), TARGET, [KEY], folds)
    forest = T.forest_classifier(TARGET, n_trees=n_trees, max_depth=max_depth)

    def scale(columns):
        return R.StandardScale(columns, with_mean=False)

    stages = [R.column_bundle(ROLES, [scale], ignore_unknown=True), forest]
    maps = T.param_maps(forest, T.grid(minInstancesPerNode=list(min_leaf)))
    accuracy = MulticlassClassificationEvaluator(labelCol=TARGET, metricName="accuracy")
    return T.grid_search(train, stages, maps, accuracy, "fold", folds).bestModel


def micro_f1(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows.filter(F.col("role") == "test"))
    return E.f1_micro(scored, TARGET, "prediction")


def importance(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return X.impurity_importance(model, rows)


def submission(model: PipelineModel, values: DataFrame, template: DataFrame) -> DataFrame:
    """Damage grade for exactly the template's buildings, matched by id."""
    return Z.submission(Z.score_classes(model, clean(values), [KEY], TARGET), template, [KEY])
