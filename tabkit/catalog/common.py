"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.operators.series import regular_grid
from tabkit.session import stable

# readings above this are taken as missing, errors as an unknown kind of event
READING_LIMIT = 60


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits)


def round_columns(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a partly missing reading and a partly missing kind."""
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(F.col("value") <= READING_LIMIT, F.col("value")).alias("reading"),
    )


READINGS_SQL = f"""readings AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type <> 'error' THEN event_type END AS kind,
         CASE WHEN value <= {READING_LIMIT} THEN value END AS reading
  FROM events)"""


def weekly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order priority and week, with its number of orders and their value; 0 in weeks without any.

    At most one row per priority and week of the calendar leaves the
    aggregation, so a series fits a task whatever the number of orders. The
    few rows are written out, so that the orders are read once only.
    """
    weekly = (
        table(spark, folder, "orders")
        .select(
            F.col("o_orderpriority").alias("priority"),
            F.date_trunc("week", F.col("o_orderdate")).cast("date").alias("week"),
            "o_totalprice",
        )
        .groupBy("priority", "week")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("orders"))
    )
    return stable(regular_grid(weekly, ["priority"], "week", "7 days", ["total", "orders"]))


WEEKLY_SQL = """sums AS (
  SELECT o_orderpriority AS priority, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
         round(sum(o_totalprice), 2) AS total, count(*) AS orders
  FROM orders GROUP BY 1, 2),
grid AS (
  SELECT priority, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week
  FROM sums GROUP BY priority),
weekly AS (
  SELECT g.priority, g.week, coalesce(s.total, 0) AS total, coalesce(s.orders, 0) AS orders
  FROM grid g LEFT JOIN sums s ON g.priority = s.priority AND g.week = s.week)"""
