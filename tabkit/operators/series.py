"""Many time series at once: regular grids, resampling, decomposition, ordered splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.ordered import (
    MAX_ROWS, NumberedRows, neighbourhood, number_rows, partition, with_totals,
)
from tabkit.session import stable


def group_values(rows: NumberedRows, values: dict[str, Column], by: list[str] = ()) -> NumberedRows:
    """Add aggregates over the row's group, or finer, with `by`."""
    return rows.replace(with_totals(rows.df, [*rows.keys, *by], values, rows.split))


def regular_grid(
    df: DataFrame, keys: list[str], date: str, step: str, values: list[str], fill=0
) -> DataFrame:
    """One row per key and date from its first to its last date; absent ones get `fill`.

    Input has one row per key and date, on a grid of the interval `step`, such
    as '7 days'. Every row brings along the absent dates up to the next one, so
    the rows are read once and nothing is joined.
    """
    following = F.lead(date).over(partition(keys).orderBy(date))
    dates = F.expr(f"sequence(`{date}`, coalesce(date_sub(_next, 1), `{date}`), interval {step})")
    filled = df.select(*keys, date, *values, following.alias("_next")).select(
        *keys, F.explode(dates).alias("_date"), date, *values
    )
    own = F.col("_date") == F.col(date)
    kept = {v: F.when(own & F.col(v).isNotNull(), F.col(v)).otherwise(F.lit(fill)) for v in values}
    return filled.withColumns(kept).drop(date).withColumnRenamed("_date", date).select(*keys, date, *values)


def resample_month(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Monthly sums labelled by month end; months without rows are there with 0."""
    monthly = df.groupBy(*keys, F.trunc(date, "MM").alias("_month")).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))
    return regular_grid(monthly.dropna(subset=["_month"]), keys, "_month", "1 month", [value]).select(
        *keys, F.last_day("_month").alias("month_end"), value
    )


def calendar_table(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Sum per entity, year and month, and the entity's largest sum rounded to tens."""
    sums = df.groupBy(*keys, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.sum(value).alias("total")
    )
    # at most twelve rows per year and entity reach this window
    return sums.withColumn("scale_top", F.bround(F.max("total").over(partition(keys)), -1))


def centred_average(w, value: Column, period: int) -> Column:
    """Centred moving average over an ordered window; an even period halves the weight of the two end rows."""
    half = period // 2
    frame = w.rowsBetween(-half, half)
    total = F.sum(value).over(frame)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    return F.when(F.count(value).over(frame) == 2 * half + 1, total / period)


def moving_average(
    df: DataFrame, keys: list[str], order: list[str], value: str, period: int, out: str = "moving_average",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    rows = number_rows(df, keys, order, max_rows=max_rows)
    half = period // 2
    rows = neighbourhood(rows, half, half, lambda w: {out: centred_average(w, F.col(value), period)})
    return rows.df.drop(rows.pos)


def decompose(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    period: int = 52,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Additive classical decomposition of each value column.

    Adds `<v>_trend`, `<v>_seasonal`, `<v>_resid` and `<v>_ok`. The trend is the
    centred moving average; its ends are a least-squares line through the
    nearest `period` trend points, at the far end without the very last one, as
    common libraries do. The seasonal part is the mean of the detrended
    values at each place of the cycle, centred over the cycle. Series shorter
    than two cycles or with nulls get `<v>_ok` false and no parts.
    """
    rows = number_rows(df, keys, order, max_rows=max_rows)
    x = {v: F.col(v).cast("double") for v in values}
    pos, half = F.col(rows.pos), period // 2
    rows = group_values(
        rows,
        {"_n": F.count(F.lit(1)), **{f"_known_{v}": F.count(F.nanvl(x[v], F.lit(None).cast("double"))) for v in values}},
    )
    n = F.col("_n")
    rows = rows.replace(
        rows.df.withColumns({f"{v}_ok": (n >= 2 * period) & (F.col(f"_known_{v}") == n) for v in values})
        .withColumn("_cycle", pos % period)
    )
    rows = neighbourhood(
        rows, half, half,
        lambda w: {f"_ma_{v}": F.when(F.col(f"{v}_ok"), centred_average(w, x[v], period)) for v in values},
    )
    if rows.split:
        rows = rows.replace(stable(rows.df))

    front, back = F.lit(half), n - 1 - half
    from_front, from_back = (pos - front).cast("double"), (pos - back).cast("double")
    in_head = (pos >= front) & (pos < F.least(front + period, back))
    in_tail = (pos >= F.greatest(front, back - period)) & (pos < back)
    fits = {}
    for v in values:
        head, tail = F.when(in_head, F.col(f"_ma_{v}")), F.when(in_tail, F.col(f"_ma_{v}"))
        fits |= {
            f"_hs_{v}": F.regr_slope(head, from_front),
            f"_hi_{v}": F.regr_intercept(head, from_front),
            f"_ts_{v}": F.regr_slope(tail, from_back),
            f"_ti_{v}": F.regr_intercept(tail, from_back),
        }
    rows = group_values(rows, fits)
    trend = {
        f"{v}_trend": F.when(pos < front, F.col(f"_hi_{v}") + F.col(f"_hs_{v}") * from_front)
        .when(pos > back, F.col(f"_ti_{v}") + F.col(f"_ts_{v}") * from_back)
        .otherwise(F.col(f"_ma_{v}"))
        for v in values
    }
    rows = rows.replace(rows.df.withColumns(trend))
    rows = group_values(rows, {f"_m_{v}": F.avg(x[v] - F.col(f"{v}_trend")) for v in values}, by=["_cycle"])
    # every place of the cycle counts once, however many rows it has
    once = F.when(pos < period, 1)
    rows = group_values(rows, {f"_centre_{v}": F.avg(once * F.col(f"_m_{v}")) for v in values})
    out = rows.df.withColumns({f"{v}_seasonal": F.col(f"_m_{v}") - F.col(f"_centre_{v}") for v in values})
    out = out.withColumns(
        {f"{v}_resid": x[v] - F.col(f"{v}_trend") - F.col(f"{v}_seasonal") for v in values}
    )
    helpers = [f"{p}{v}" for p in ("_known_", "_ma_", "_hs_", "_hi_", "_ts_", "_ti_", "_m_", "_centre_") for v in values]
    return out.drop(*helpers, "_n", "_cycle", rows.pos)


def time_folds(
    df: DataFrame, keys: list[str], order: list[str], n_splits: int = 5, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Expanding time-ordered folds: each row once per fold (1..n) it belongs to, with its role."""
    rows = group_values(number_rows(df, keys, order, max_rows=max_rows), {"_n": F.count(F.lit(1))})
    size = F.floor(F.col("_n") / (n_splits + 1))
    start = F.col("_n") - (n_splits - F.col("fold") + 1) * size
    pos = F.col(rows.pos)
    return (
        rows.df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
        .filter((size > 0) & (pos < start + size))
        .withColumn("role", F.when(pos < start, "train").otherwise("test"))
        .drop(rows.pos, "_n")
    )


def time_split(
    df: DataFrame, keys: list[str], order: list[str], n_splits: int = 5, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """The last of `n_splits` expanding folds: a `role` of train or test for every row."""
    rows = group_values(number_rows(df, keys, order, max_rows=max_rows), {"_n": F.count(F.lit(1))})
    size = F.floor(F.col("_n") / (n_splits + 1))
    role = F.when(F.col(rows.pos) >= F.col("_n") - size, "test").otherwise("train")
    return rows.df.withColumn("role", role).drop(rows.pos, "_n")


def first_test_dates(split: DataFrame, keys: list[str], date: str) -> DataFrame:
    return split.filter(F.col("role") == "test").groupBy(*keys).agg(F.min(date).alias("first_test"))
