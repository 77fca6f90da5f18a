"""Frequency tables, feature-by-target profiles and survey layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.functions.scalars import recode


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values, most frequent first, ties by value."""
    return df.dropna(subset=[column]).groupBy(column).count().orderBy(F.desc("count"), column)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts with the missing category kept."""
    return df.groupBy(column).count()


def long_form(df: DataFrame, columns: list[str], ids: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per (row, column); values of mixed types are compared as text."""
    types = {df.schema[c].dataType for c in columns}
    if len(types) > 1:
        df = df.withColumns({c: F.col(c).cast("string") for c in columns})
    return df.select(*ids, *columns).unpivot(ids, columns, name, value)


def value_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and percentage of the non-null total, for several columns in one scan."""
    counts = long_form(df, columns, []).dropna(subset=["value"]).groupBy("feature", "value").count()
    # one row per listed column, so this side can never outgrow a broadcast
    totals = counts.groupBy("feature").agg(F.sum("count").alias("_total"))
    return (
        counts.join(F.broadcast(totals), "feature")
        .withColumn("percentage", 100 * F.col("count") / F.col("_total"))
        .drop("_total")
    )


def key_counts(df: DataFrame, keys: list[str], counted: str, name: str = "counts") -> DataFrame:
    """Non-null `counted` per key combination; rows with a null key are left out."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(counted).alias(name))


def profile_by_target(df: DataFrame, features: list[str], target: str, counted: str) -> DataFrame:
    """(feature, value, target, count) for many features with one scan and one shuffle."""
    text = df.select(counted, target, *[F.col(c).cast("string").alias(c) for c in features])
    return (
        text.unpivot([counted, target], features, "feature", "value")
        .dropna(subset=["value", target])
        .groupBy("feature", "value", target)
        .agg(F.count(counted).alias("count"))
    )


def question_responses(df: DataFrame, questions: dict[str, str]) -> DataFrame:
    """Answer counts per question, with the question's readable text."""
    counts = long_form(df, list(questions), []).dropna(subset=["value"]).groupBy("feature", "value").count()
    return counts.select(
        recode(F.col("feature"), questions).alias("question"),
        F.col("value").alias("type"),
        F.col("count").alias("value"),
    )


def flag_above(df: DataFrame, count: str = "count", threshold: int = 1000) -> DataFrame:
    return df.withColumn("highlight", F.col(count) > threshold)


def diverging_layout(df: DataFrame, question: str, code: str, value: str) -> DataFrame:
    """Bar ends of a diverging chart, centred on the middle of code 0.

    Input has one row per question and ordered answer code (-2..2), so the
    window holds the handful of codes of one question. Absent codes count as 0.
    """
    by_question = W.partitionBy(question)
    running = by_question.orderBy(code).rowsBetween(W.unboundedPreceding, 0)
    share = F.col(value) / F.sum(value).over(by_question) * 100

    def share_of(n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col(code) == n, F.col("percentage"))).over(by_question), F.lit(0.0))

    return (
        df.withColumn("percentage", share)
        .withColumn(
            "percentage_end",
            F.sum("percentage").over(running) - (share_of(-2) + share_of(-1) + share_of(0) / 2),
        )
        .withColumn("percentage_start", F.col("percentage_end") - F.col("percentage"))
    )


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of the listed `column` values per `row` value, and each as a share of all the row's known values."""
    n = [F.count(F.when(F.col(column) == v, 1)).alias(f"n_{v}") for v in values]
    counts = df.dropna(subset=[row, column]).groupBy(row).agg(*n, F.count(F.lit(1)).alias("_total"))
    shares = {f"pct_{v}": F.try_divide(100.0 * F.col(f"n_{v}"), F.col("_total")) for v in values}
    return counts.withColumns(shares).drop("_total")
