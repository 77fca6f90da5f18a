"""Moments, skew, correlation, exact quantiles, box plots and normal-probability points."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.functions.scalars import box_cox, inverse_normal, skew_candidates
from tabkit.operators.gram import pair_correlations
from tabkit.operators.ordered import AT, MAX_ROWS, null_safe_join, number_rows, partition, split_hot, with_totals
from tabkit.operators.profile import long_form
from tabkit.operators.ranks import values_at_ranks
from tabkit.session import small_side


def as_double(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    return df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])


def mean_var(df: DataFrame, column: str, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.avg(column).alias("mean"), F.var_samp(column).alias("var"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.agg(*aggs)


def sample_skewness(x) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(
        (n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    )


def normal_label(skew: Column) -> Column:
    return F.when((skew > -0.5) & (skew < 0.5), "normal")


def skew_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness per column, labelled 'normal' when between -0.5 and 0.5."""
    one_row = df.agg(*[sample_skewness(F.col(c).cast("double")).alias(c) for c in columns])
    long = one_row.unpivot([], columns, "feature", "skewness")
    return long.withColumn("skewness_label", normal_label(F.col("skewness")))


def transform_skews(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness of each column under each normalising transform, from one scan."""
    aggs = [
        sample_skewness(x).alias(f"{i}:{name}")
        for i, c in enumerate(columns)
        for name, x in skew_candidates(F.col(c).cast("double")).items()
    ]
    one_row = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit(name).alias("transform"), F.col(f"`{i}:{name}`").alias("skewness")
            )
            for i, c in enumerate(columns)
            for name in skew_candidates(F.lit(0.0))
        ]
    )
    return one_row.select(F.inline(rows))


def best_transform(skews: DataFrame) -> DataFrame:
    """Per feature the transform whose skewness is nearest to zero."""
    nearest = F.min_by("transform", F.struct(F.abs("skewness"), F.col("transform")))
    return skews.dropna(subset=["skewness"]).groupBy("feature").agg(
        nearest.alias("transform"), F.min(F.abs("skewness")).alias("abs_skewness")
    )


def box_cox_exponent(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, rounds: int = 4) -> float:
    """Exponent of greatest likelihood of the Box-Cox transform, to about a ten-thousandth.

    Each round tries 21 exponents in one scan and narrows the range around the best.
    """
    x = F.col(column).cast("double")
    positive = df.filter(x > 0).select(x.alias("x"))
    best = 0.0
    for _ in range(rounds):
        step = (high - low) / 20
        tried = [round(low + i * step, 12) for i in range(21)]
        row = positive.agg(
            F.sum(F.ln("x")).alias("logs"), F.count("x").alias("n"),
            *[F.var_pop(box_cox(F.col("x"), e)).alias(str(i)) for i, e in enumerate(tried)],
        ).first()
        if not row["n"]:
            return 1.0
        likelihood = [
            (e - 1) * row["logs"] - row["n"] / 2 * math.log(row[str(i)]) if row[str(i)] else -math.inf
            for i, e in enumerate(tried)
        ]
        best = tried[likelihood.index(max(likelihood))]
        low, high = best - step, best + step
    return best


def correlations(df: DataFrame, columns: list[str], absolute: bool = False) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair, in long form, from one scan.

    Null for a column that does not vary, or with fewer than two common rows.
    """
    columns = sorted(columns)
    out = pair_correlations(df, columns, columns)
    return out.withColumn("corr", F.abs("corr")) if absolute else out


def high_correlations(corr: DataFrame, cut: float = 0.95) -> DataFrame:
    return corr.filter((F.abs("corr") > cut) & (F.col("feature_a") != F.col("feature_b")))


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, highest first."""
    pairs = pair_correlations(df, features, [target])
    return pairs.select(F.col("feature_a").alias("feature"), "corr").orderBy(F.desc_nulls_last("corr"), "feature")


def redundant_columns(corr_pairs: list[tuple[str, str]]) -> list[str]:
    """One of each highly correlated pair, chosen greedily in name order."""
    dropped: set[str] = set()
    for a, b in sorted(tuple(sorted(p)) for p in corr_pairs):
        if a not in dropped and b not in dropped:
            dropped.add(b)
    return sorted(dropped)


def rare_binary_columns(df: DataFrame, columns: list[str], share: float) -> list[str]:
    """0/1 columns whose rarer value has less than `share` of the rows."""
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and min(row[c], 1 - row[c]) < share]


def _between(low: Column, high: Column, share: Column) -> Column:
    return F.when(low == high, low).otherwise(low + (high - low) * share)


def _interpolated(p: float, total: Column, at: Callable[[Column], Column]) -> Column:
    exact = F.lit(p) * (total - 1)
    return _between(at(F.floor(exact)), at(F.ceil(exact)), exact - F.floor(exact))


def _small_quantiles(known: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Quantiles of groups that fit a task: equal values are folded, running counts find the ranks."""
    folded = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = partition(keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = folded.withColumns({"_upto": F.sum("_c").over(upto), "_total": F.sum("_c").over(partition(keys))})

    def at(p: float, rounder) -> Column:
        rank = rounder(F.lit(p) * (F.col("_total") - 1))
        here = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)
        return F.max(F.when(here, F.col("_v")))

    def interpolated(p: float) -> Column:
        exact = F.lit(p) * (F.max("_total") - 1)
        return _between(at(p, F.floor), at(p, F.ceil), exact - F.floor(exact))

    return ranked.groupBy(*keys).agg(*[interpolated(p).alias(name) for name, p in probabilities.items()])


def _known_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))


def quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per named probability; nulls and NaN don't count.

    Groups above `max_rows` get the values at their ranks by narrowing cells,
    which shuffles counts only and reads `df` a few times; the rest are ranked
    by a window. Without keys there is one row if `df` has a value.
    """
    known, by = _known_values(df, keys, value), keys
    if not keys:
        known, by = known.withColumn("_all", F.lit(0)), ["_all"]
    hot = None
    if max_rows is not None:
        sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
        hot = small_side(sizes.filter(F.col("_total") > max_rows))
    if hot is None or hot.isEmpty():
        return _small_quantiles(known, by, probabilities).drop("_all")
    total = F.col("_total")
    ranks = [r for p in probabilities.values() for r in (F.floor(F.lit(p) * (total - 1)), F.ceil(F.lit(p) * (total - 1)))]
    targets = hot.select(*by, F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"))
    found = values_at_ranks(known, by, targets)
    # two entries per probability and group
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    large = null_safe_join(hot, held, by).select(
        *by, *[_interpolated(p, total, lambda rank: F.element_at("_at", rank)).alias(name) for name, p in probabilities.items()]
    )
    if not keys:
        return large.drop("_all")
    small = null_safe_join(known, hot.select(*by, F.lit(True).alias("_hot")), by).filter("_hot is null").drop("_hot")
    return large.unionByName(_small_quantiles(small, by, probabilities))


def approximate_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Quantiles from one mergeable sketch per group and one scan; a rank is off by at most a share of 1 / accuracy.

    Always a value of the group, never between two. Ask for it by name: nothing
    else in the library uses it in place of the exact ones.
    """
    sketch = F.percentile_approx("_v", list(probabilities.values()), accuracy).alias("_found")
    found = _known_values(df, keys, value).groupBy(*keys).agg(sketch)
    return found.select(*keys, *[F.col("_found")[i].alias(name) for i, name in enumerate(probabilities)])


def box_stats(df: DataFrame, keys: list[str], value: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, and the number of points outside them, per group."""
    q = small_side(quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, max_rows))
    v = F.col(value).cast("double")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - spread) & (v <= F.col("q3") + spread)
    return (
        null_safe_join(df.select(*keys, value), q, keys, "inner")
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("n_outliers"),
        )
    )


def box_outliers(df: DataFrame, keys: list[str], value: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """The rows outside the 1.5 IQR fences of their group."""
    q = small_side(quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}, max_rows))
    v, spread = F.col(value).cast("double"), 1.5 * (F.col("_q3") - F.col("_q1"))
    outside = (v < F.col("_q1") - spread) | (v > F.col("_q3") + spread)
    return null_safe_join(df, q, keys, "inner").filter(outside).drop("_q1", "_q3")


def probability_points(
    df: DataFrame, columns: list[str], row_id: str, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """(feature, theoretical, ordered) points of a normal probability plot, Filliben medians."""
    long = (
        long_form(as_double(df, columns, [row_id]), columns, [row_id])
        .dropna(subset=["value"])
        .select("feature", row_id, "value")
    )
    ranked = number_rows(long, ["feature"], ["value", row_id], "_pos", max_rows)
    sized = with_totals(ranked.df, ["feature"], {"_n": F.count(F.lit(1))}, ranked.split)
    i, n = F.col("_pos") + 1, F.col("_n").cast("double")
    top = F.pow(F.lit(0.5), 1 / n)
    median = F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    return sized.select(
        "feature", row_id, inverse_normal(median).alias("theoretical"), F.col("value").alias("ordered")
    )


def probability_fit(points: DataFrame) -> DataFrame:
    """Straight line through the points of each feature, and its correlation."""
    y, x = "ordered", "theoretical"
    return points.groupBy("feature").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")
    )


def is_monotonic(
    df: DataFrame, column: str, order: list[str], keys: list[str] = (), max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Whether `column` never falls along `order` (one row per key; a null makes it false).

    Non-falling means that no value is below an earlier one, which each bucket
    can tell from its own rows and the highest value of the buckets before it.
    """
    keys = list(keys)
    laid, buckets = split_hot(df, keys, order, max_rows)
    w = partition(keys + buckets).orderBy(*([AT] if buckets else order)).rowsBetween(W.unboundedPreceding, -1)
    c = F.col(column)
    earlier = F.max(c).over(w)
    ok = c.isNotNull() & F.coalesce(c >= earlier, F.lit(True))
    parts = (
        laid.withColumn("_ok", ok)
        .groupBy(*keys, *buckets)
        .agg(F.bool_and("_ok").alias("_ok"), F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    )
    if buckets:
        before = partition(keys).orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
        above = F.coalesce(F.col("_lo") >= F.max("_hi").over(before), F.lit(True))
        parts = parts.withColumn("_ok", F.col("_ok") & above)
    return parts.groupBy(*keys).agg(F.bool_and("_ok").alias("monotonic"))


def phi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Association of two 0/1 columns."""
    return df.agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("phi"))
