"""Registered queries: fills along time, resampling, decomposition, ordered splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.catalog.common import READINGS_SQL, WEEKLY_SQL, readings, round_columns, table, weekly_orders
from tabkit.operators import impute as M
from tabkit.operators import series as W
from tabkit.operators.ordered import number_rows
from tabkit.operators.split import contiguous_folds

SERIES = ["event_type"]
ORDER = ["ts", "event_id"]
PERIOD = 52


def _series(spark, d):
    return readings(spark, d).select("event_id", "event_type", "ts", "reading")


def ffill(spark, d):
    return M.forward_fill(_series(spark, d), SERIES, ORDER, ["reading"])


def ffill_split(spark, d):
    """The same with groups cut at a low limit, so that carrying between buckets is checked too."""
    return M.forward_fill(_series(spark, d), SERIES, ORDER, ["reading"], max_rows=1_000)


def interp_linear(spark, d):
    return round_columns(M.interpolate_linear(_series(spark, d), SERIES, ORDER, ["reading"]), ["reading"], 8)


def interp_cubic(spark, d):
    return round_columns(M.interpolate_cubic(_series(spark, d), SERIES, ORDER, ["reading"]), ["reading"])


def cubic_polynomial_gaps(spark, d):
    """A cubic of the row's place with the gaps of the readings: the spline must give the polynomial back."""
    series = number_rows(_series(spark, d), SERIES, ORDER).df
    u = F.col("_pos") / 1000.0
    known = series.withColumn("wave", F.when(F.col("reading").isNotNull(), 1 + u - 2 * u * u + u * u * u / 4))
    return round_columns(M.interpolate_cubic(known, SERIES, ORDER, ["wave"]), ["wave"], 6).select("event_id", "event_type", "wave")


def fill_compare(spark, d):
    daily = (
        readings(spark, d)
        .groupBy("event_type", F.col("ts").cast("date").alias("day"))
        .agg(F.max("reading").alias("reading"))
    )
    # a day's highest reading counts as missing when it is too close to the limit to trust
    daily = daily.withColumn("reading", F.when(F.col("reading") < 59, F.col("reading")))
    methods = ("ffill", "mean", "linear", "zero")  # interp_cubic covers the spline
    return round_columns(M.compare_fills(daily, SERIES, ["day"], "reading", methods, max_rows=None), ["filled"], 8)


def moving_average(spark, d):
    out = W.moving_average(weekly_orders(spark, d), ["priority"], ["week"], "orders", PERIOD, max_rows=None)
    return round_columns(out, ["moving_average"], 6)


def decompose(spark, d):
    out = W.decompose(weekly_orders(spark, d), ["priority"], ["week"], ["orders"], PERIOD, max_rows=None)
    return round_columns(out, ["orders_trend", "orders_seasonal", "orders_resid"], 6)


def decompose_readings(spark, d):
    """Whole event series, cut at a low limit; the cycle is an arbitrary ninety events."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    out = W.decompose(events, SERIES, ORDER, ["value"], 90, max_rows=1_000)
    return round_columns(out, ["value_trend", "value_seasonal", "value_resid"], 7)


def resample_month(spark, d):
    orders = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return round_columns(W.resample_month(orders, ["o_orderpriority"], "day", "o_totalprice"), ["o_totalprice"], 2)


def calendar(spark, d):
    out = W.calendar_table(table(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", "o_totalprice")
    return round_columns(out, ["total"], 2)


def ts_split(spark, d):
    return W.time_split(weekly_orders(spark, d), ["priority"], ["week"], 5, max_rows=None)


def ts_folds(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return W.time_folds(events, SERIES, ORDER, 5)


def first_test_week(spark, d):
    split = W.time_split(weekly_orders(spark, d), ["priority"], ["week"], 5, max_rows=None)
    return W.first_test_dates(split, ["priority"], "week")


def block_folds(spark, d):
    return contiguous_folds(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 3)


QUERIES = {
    f.__name__: f
    for f in (
        ffill, ffill_split, interp_linear, interp_cubic, cubic_polynomial_gaps, fill_compare, moving_average, decompose, decompose_readings,
        resample_month, calendar, ts_split, ts_folds, first_test_week, block_folds,
    )
}

FFILL_SQL = f"""WITH {READINGS_SQL} SELECT event_id, event_type, ts,
  last_value(reading IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading FROM readings"""


def _linear_sql(src: str, key: str, order: str, v: str) -> str:
    """CTE `lin`: rows with position, neighbours and the interpolated value."""
    back = f"(PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = f"(PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    known = f"CASE WHEN {v} IS NOT NULL THEN pos END"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order})::DOUBLE AS pos FROM {src}),
      around AS (SELECT *, last_value({v} IGNORE NULLS) OVER {back} AS v0, last_value({known} IGNORE NULLS) OVER {back} AS x0,
        first_value({v} IGNORE NULLS) OVER {ahead} AS v1, first_value({known} IGNORE NULLS) OVER {ahead} AS x1 FROM numbered),
      lin AS (SELECT *, CASE WHEN {v} IS NOT NULL THEN {v} WHEN v1 IS NULL THEN v0
        WHEN v0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (pos - x0) / (x1 - x0) END AS line FROM around)"""


def _decompose_sql(src: str, key: str, order: str, v: str, period: int, digits: int, keep: str) -> str:
    half = period // 2
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i,
        count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
      ma AS (SELECT *, CASE WHEN n >= {2 * period} AND i >= {half} AND i <= n - 1 - {half} THEN
        (sum({v}) OVER w - first_value({v}) OVER w / 2 - last_value({v}) OVER w / 2) / {period} END AS t
        FROM n WINDOW w AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
      fit AS (SELECT {key},
        regr_slope(t, i::DOUBLE) FILTER (i < least({half} + {period}, n - 1 - {half})) AS head_slope,
        regr_intercept(t, i::DOUBLE) FILTER (i < least({half} + {period}, n - 1 - {half})) AS head_start,
        regr_slope(t, i::DOUBLE) FILTER (i >= n - 1 - {half} - {period} AND i < n - 1 - {half}) AS tail_slope,
        regr_intercept(t, i::DOUBLE) FILTER (i >= n - 1 - {half} - {period} AND i < n - 1 - {half}) AS tail_start
        FROM ma GROUP BY {key}),
      tr AS (SELECT ma.*, CASE WHEN n < {2 * period} THEN NULL WHEN i < {half} THEN head_start + head_slope * i
        WHEN i > n - 1 - {half} THEN tail_start + tail_slope * i ELSE t END AS trend FROM ma JOIN fit USING ({key})),
      sm AS (SELECT {key}, i % {period} AS k, avg({v} - trend) AS m FROM tr GROUP BY 1, 2),
      ss AS (SELECT {key}, k, m - avg(m) OVER (PARTITION BY {key}) AS s FROM sm)
      SELECT {keep}, n >= {2 * period} AS {v}_ok, round(trend, {digits}) AS {v}_trend, round(s, {digits}) AS {v}_seasonal,
        round({v} - trend - s, {digits}) AS {v}_resid
      FROM tr JOIN ss ON tr.{key} = ss.{key} AND i % {period} = k"""


ORACLE = {
    "ffill": FFILL_SQL,
    "ffill_split": FFILL_SQL,
    "interp_linear": f"""WITH {READINGS_SQL}, {_linear_sql("readings", "event_type", "ts, event_id", "reading")}
      SELECT event_id, event_type, ts, round(line, 8) AS reading FROM lin""",
    "cubic_polynomial_gaps": f"""WITH {READINGS_SQL}, n AS (SELECT event_id, event_type, reading,
        (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::DOUBLE AS pos FROM readings),
      ends AS (SELECT event_type, min(pos) AS a, max(pos) AS b, count(*) AS k FROM n WHERE reading IS NOT NULL GROUP BY 1)
      SELECT event_id, n.event_type, CASE WHEN reading IS NOT NULL OR (k >= 4 AND pos BETWEEN a AND b) THEN
        round(1 + pos / 1000.0::DOUBLE - 2 * (pos / 1000.0::DOUBLE) * (pos / 1000.0::DOUBLE)
          + (pos / 1000.0::DOUBLE) * (pos / 1000.0::DOUBLE) * (pos / 1000.0::DOUBLE) / 4, 6) END AS wave
      FROM n LEFT JOIN ends ON n.event_type = ends.event_type""",
    "fill_compare": f"""WITH {READINGS_SQL}, days AS (
        SELECT event_type, CAST(ts AS DATE) AS day, max(reading) AS r FROM readings GROUP BY 1, 2),
      daily AS (SELECT event_type, day, CASE WHEN r < 59 THEN r END AS original FROM days),
      {_linear_sql("daily", "event_type", "day", "original")}, f AS (
      SELECT event_type, day, 'ffill' AS method, original, v0 AS filled FROM lin UNION ALL
      SELECT event_type, day, 'linear', original, line FROM lin UNION ALL
      SELECT event_type, day, 'zero', original, coalesce(original, 0) FROM lin UNION ALL
      SELECT event_type, day, 'mean', original, coalesce(original, (SELECT avg(original) FROM daily)) FROM lin)
      SELECT event_type, day, 'reading' AS feature, method, original, round(filled, 8) AS filled FROM f""",
    "moving_average": f"""WITH {WEEKLY_SQL} SELECT priority, week, total, orders,
        round(CASE WHEN count(*) OVER w = {PERIOD + 1} THEN
          (sum(orders) OVER w - first_value(orders) OVER w / 2 - last_value(orders) OVER w / 2) / {PERIOD} END, 6) AS moving_average
      FROM weekly WINDOW w AS (PARTITION BY priority ORDER BY week
        ROWS BETWEEN {PERIOD // 2} PRECEDING AND {PERIOD // 2} FOLLOWING)""",
    "decompose": f"WITH {WEEKLY_SQL}, "
    + _decompose_sql("weekly", "priority", "week", "orders", PERIOD, 6, "tr.priority, week, total, orders"),
    "decompose_readings": "WITH "
    + _decompose_sql("events", "event_type", "ts, event_id", "value", 90, 7, "event_id, tr.event_type, tr.ts, value"),
    "resample_month": """WITH s AS (SELECT o_orderpriority, last_day(o_orderdate) AS month_end, sum(o_totalprice) AS v
        FROM orders GROUP BY 1, 2),
      g AS (SELECT o_orderpriority, last_day(unnest(generate_series(date_trunc('month', min(month_end)),
        date_trunc('month', max(month_end)), INTERVAL 1 MONTH))) AS month_end FROM s GROUP BY 1)
      SELECT g.o_orderpriority, g.month_end, round(coalesce(v, 0), 2) AS o_totalprice
      FROM g LEFT JOIN s ON g.o_orderpriority = s.o_orderpriority AND g.month_end = s.month_end""",
    "calendar": """WITH s AS (SELECT o_orderstatus, year(o_orderdate) AS year, month(o_orderdate) AS month,
        sum(o_totalprice) AS total FROM orders GROUP BY 1, 2, 3)
      SELECT o_orderstatus, year, month, round(total, 2) AS total,
        round_even(max(total) OVER (PARTITION BY o_orderstatus), -1) AS scale_top FROM s""",
    "ts_split": f"""WITH {WEEKLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY week) AS i,
        count(*) OVER (PARTITION BY priority) AS n FROM weekly)
      SELECT priority, week, total, orders, CASE WHEN i > n - n // 6 THEN 'test' ELSE 'train' END AS role FROM r""",
    "ts_folds": """WITH r AS (SELECT event_id, event_type, ts,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) // 6 AS size, count(*) OVER (PARTITION BY event_type) AS n FROM events),
      f AS (SELECT *, n - (6 - fold) * size AS start FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS fold))
      SELECT event_id, event_type, ts, fold, CASE WHEN i < start THEN 'train' ELSE 'test' END AS role
      FROM f WHERE i < start + size""",
    "first_test_week": f"""WITH {WEEKLY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY week) AS i,
        count(*) OVER (PARTITION BY priority) AS n FROM weekly)
      SELECT priority, min(week) AS first_test FROM r WHERE i > n - n // 6 GROUP BY 1""",
    "block_folds": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
        count(*) OVER () AS n FROM orders)
      SELECT o_orderkey, CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1)
        ELSE n % 3 + (i - (n % 3) * (n // 3 + 1)) // (n // 3) END AS fold FROM r""",
}
