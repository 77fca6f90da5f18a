"""Scoring new rows and shaping submissions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.joins import assert_same_keys


def positive_probability(column: str) -> Column:
    return vector_to_array(F.col(column))[1]


def score_classes(model, df: DataFrame, keys: list[str], out: str = "prediction") -> DataFrame:
    return model.transform(df).select(*keys, F.col("prediction").cast("int").alias(out))


def score_counts(model, df: DataFrame, keep: list[str], out: str = "y_pred") -> DataFrame:
    """Numeric prediction cut to a whole number, towards zero."""
    return model.transform(df).select(*keep, F.col("prediction").cast("int").alias(out))


def score_probabilities(model, df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Probability of 1 per label."""
    scored = model.transform(df)
    return scored.select(*keys, *[positive_probability(f"{n}_probability").alias(n) for n in labels])


def submission(scored: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions for exactly the template's keys, in the template's columns.

    Matched by key; raises when the two tables hold different keys.
    """
    assert_same_keys(scored, template, keys)
    columns = [c for c in template.columns if c not in keys]
    return template.select(*keys).join(scored, keys, "inner").select(*keys, *columns)
