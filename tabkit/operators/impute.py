"""Missing values: constants, statistics, fills along an order, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators.ordered import MAX_ROWS, last_known, nearest_values, null_safe_join, number_rows
from tabkit.operators.profile import long_form
from tabkit.operators.spline import knot_curvature
from tabkit.operators.stats import as_double, quantiles
from tabkit.session import small_side


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """One number per listed column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()


def fill_mean(df: DataFrame, columns: list[str], entity: list[str] | None = None) -> DataFrame:
    """Fill with the column mean over the whole table, or over each entity."""
    if entity:
        means = df.groupBy(*entity).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
        df = null_safe_join(df, small_side(means), entity)
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{c}")) for c in columns}
        return df.withColumns(filled).drop(*[f"_mean_{c}" for c in columns])
    means = column_means(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def column_medians(df: DataFrame, columns: list[str], max_rows: int | None = MAX_ROWS) -> dict[str, float]:
    """Exact median per column, averaging the two middle values."""
    long = long_form(as_double(df, columns), columns, [])
    found = quantiles(long, ["feature"], "value", {"median": 0.5}, max_rows).collect()
    return {r["feature"]: r["median"] for r in found}


def column_modes(df: DataFrame, columns: list[str]) -> dict:
    """Most frequent non-null value per column, the smallest one on ties.

    Counted by (column, value) across the cluster, so a column with very many
    distinct values does not build one map in one task.
    """
    out = {}
    types: dict = {}
    for c in columns:
        types.setdefault(df.schema[c].dataType, []).append(c)
    for same_type in types.values():
        counts = long_form(df, same_type, []).dropna(subset=["value"]).groupBy("feature", "value").count()
        best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("b"))
        out.update({r["feature"]: r["value"] for r in best.select("feature", "b.value").collect()})
    return out


def fill_median(df: DataFrame, columns: list[str], max_rows: int | None = MAX_ROWS) -> DataFrame:
    medians = column_medians(df, columns, max_rows)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in columns})


def fill_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    modes = column_modes(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c))) for c in columns})


def forward_fill(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Carry the last known value forward within each entity."""
    return last_known(df, keys, order, {c: F.col(c) for c in columns}, max_rows)


def interpolate_linear(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Straight line across gaps, rows equally spaced.

    Nulls before the first known value stay; those after the last one take it.
    """
    rows = number_rows(df, keys, order, max_rows=max_rows)
    x, values = F.col(rows.pos), {c: F.col(c).cast("double") for c in columns}
    points = {c: F.when(v.isNotNull(), F.struct(x.alias("x"), v.alias("y"))) for c, v in values.items()}
    # all columns share one pair of sorts
    rows = nearest_values(rows, {f"_prev_{c}": p for c, p in points.items()}, {f"_next_{c}": p for c, p in points.items()})
    filled = {}
    for c, value in values.items():
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        line = p["y"] + (n["y"] - p["y"]) * (x - p["x"]) / (n["x"] - p["x"])
        filled[c] = F.when(value.isNotNull(), value).when(n.isNull(), p["y"]).otherwise(line)
    return rows.df.withColumns(filled).drop(rows.pos, *[f"{side}{c}" for c in columns for side in ("_prev_", "_next_")])


def interpolate_cubic(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Not-a-knot cubic spline across interior gaps, rows equally spaced.

    Entities with fewer than four known values keep their nulls.
    """
    rows = number_rows(df, keys, order, max_rows=max_rows)
    for c in columns:
        x, value = F.col(rows.pos), F.col(c).cast("double")
        curved = knot_curvature(rows, value, max_rows)
        at_row = rows.replace(null_safe_join(rows.df, curved, [*keys, rows.pos]))
        point = F.when(F.col("_m").isNotNull(), F.struct(x.alias("x"), value.alias("y"), F.col("_m").alias("m")))
        rows = nearest_values(at_row, {"_prev": point}, {"_next": point})
        p, n = F.col("_prev"), F.col("_next")
        h = (n["x"] - p["x"]).cast("double")
        a, b = (n["x"] - x) / h, (x - p["x"]) / h
        curve = a * p["y"] + b * n["y"] + ((a * a * a - a) * p["m"] + (b * b * b - b) * n["m"]) * h * h / 6
        filled = F.when(value.isNotNull(), value).otherwise(curve)
        rows = rows.replace(rows.df.withColumn(c, filled).drop("_prev", "_next", "_m"))
    return rows.df.drop(rows.pos)


def column_minima(df: DataFrame, columns: list[str]) -> DataFrame:
    """Smallest value per column, which brings placeholders such as -9999 to light."""
    return df.agg(*[F.min(c).alias(c) for c in columns])


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


FILL_METHODS = ("ffill", "mean", "linear", "cubic", "zero")


def compare_fills(
    df: DataFrame, keys: list[str], order: list[str], feature: str, methods: tuple = FILL_METHODS,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Long table (keys, order, feature, method, original, filled) of the fill methods side by side."""
    ids = [*keys, *order]
    wide = df.select(*ids, F.col(feature).cast("double").alias("original"))
    mean = column_means(wide, ["original"])["original"] if "mean" in methods else None
    constant = {"mean": F.lit(mean).cast("double"), "zero": F.lit(0.0)}
    along = {"ffill": forward_fill, "linear": interpolate_linear, "cubic": interpolate_cubic}
    for m in methods:
        if m in constant:
            wide = wide.withColumn(m, F.coalesce("original", constant[m]))
        else:
            wide = along[m](wide.withColumn(m, F.col("original")), keys, order, [m], max_rows)
    long = wide.unpivot([*ids, "original"], list(methods), "method", "filled")
    return long.withColumn("feature", F.lit(feature)).select(*ids, "feature", "method", "original", "filled")
