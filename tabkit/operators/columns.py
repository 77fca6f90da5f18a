"""Column lists, row filters, ordering and stacking of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def columns_containing(df: DataFrame, *terms: str) -> list[str]:
    return [c for c in df.columns if any(t in c for t in terms)]


def columns_except(df: DataFrame, excluded: list[str]) -> list[str]:
    return sorted(c for c in df.columns if c not in set(excluded))


def only(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == value)


def apply_to(df: DataFrame, columns: list[str], expression) -> DataFrame:
    """Replace each listed column by `expression(column)`."""
    return df.withColumns({c: expression(F.col(f"`{c}`")) for c in columns})


def shape(df: DataFrame, entity: str) -> DataFrame:
    """Row count per entity, and the column count of the rest of the table."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns) - 1)
    )


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def sort_by_date(df: DataFrame, date: str, *ties: str) -> DataFrame:
    return df.orderBy(date, *ties)


def sort_descending(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties)


def category_order(column: Column, categories: list[str]) -> Column:
    """Place of the value in the list; null for values outside it."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), column)
    return F.when(place > 0, place.cast("int"))


def sort_by_category(df: DataFrame, column: str, categories: list[str], *ties: str) -> DataFrame:
    return df.orderBy(category_order(F.col(column), categories).asc_nulls_last(), *ties)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def largest_errors(df: DataFrame, predicted: str, actual: str, k: int, *ties: str) -> DataFrame:
    """The `k` rows whose prediction is furthest off."""
    return (
        df.withColumn("abs_error", F.abs(F.col(predicted) - F.col(actual)))
        .orderBy(F.desc_nulls_last("abs_error"), *ties)
        .limit(k)
    )
