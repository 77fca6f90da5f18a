"""Sums of products over pairs of columns, each pair over the rows in which both are known, from one scan.

Every task multiplies the matrix of its values, and that of what is known, with
each other, batch by batch, and sends on one row of sums per column. These add
up by aggregation. Values are taken relative to one known value of their column,
so that a large mean does not drown a small spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns a side whose sums a task holds; more columns are read in tiles.
TILE = 1000
#: Sums per task from which on scans are merged into about two tasks a core.
MANY_SUMS = 10_000
#: A spread below this part of the squares is rounding of a constant.
CONSTANT = 1e-12

#: Rows with both known, sums of x, y, x², y² and xy over them, and rows with an infinite or NaN value among the two.
_KINDS = ("n", "x", "y", "xx", "yy", "xy", "odd")


def pair_sums(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(at, sums): per column of `left` its seven sums against every column of `right`, kind by kind."""
    columns = list(dict.fromkeys([*left, *right]))
    at_left, at_right = [columns.index(c) for c in left], [columns.index(c) for c in right]
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(columns)])
    if len(left) * len(right) > MANY_SUMS:
        doubles = doubles.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    first = doubles.limit(1000).agg(*[F.first(F.when(F.abs(c) < float("inf"), F.col(c)), ignorenulls=True).alias(c) for c in doubles.columns]).first()
    shift = np.array([v or 0.0 for v in first])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_KINDS), len(left), len(right)))
        for batch in batches:
            null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            odd = ~np.isfinite(x)
            x = np.where(null | odd, 0.0, x - shift)
            known, odd = (~null).astype(float), (odd & ~null).astype(float)
            a, b, ka, kb = x[:, at_left], x[:, at_right], known[:, at_left], known[:, at_right]
            total[0] += ka.T @ kb
            total[1] += a.T @ kb
            total[2] += ka.T @ b
            total[3] += (a * a).T @ kb
            total[4] += ka.T @ (b * b)
            total[5] += a.T @ b
            if odd.any():
                total[6] += odd[:, at_left].T @ kb + ka.T @ odd[:, at_right]
        rows = total.transpose(1, 0, 2).reshape(len(left), -1)
        sums = pa.ListArray.from_arrays(np.arange(len(left) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left), dtype=np.int32)), sums], names=["at", "sums"])

    partial = doubles.mapInArrow(mapped, "at int, sums array<double>")
    summed = partial.groupBy("at").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return summed.select("at", vector_to_array("sums").alias("sums"))


def _corr(sums: Column, j: Column, width: int) -> Column:
    n, x, y, xx, yy, xy, odd = (F.element_at(sums, F.lit(k * width + 1) + j) for k in range(len(_KINDS)))
    spread_x, spread_y = xx - F.try_divide(x * x, n), yy - F.try_divide(y * y, n)
    varies = (n > 1) & (spread_x > CONSTANT * xx) & (spread_y > CONSTANT * yy)
    r = F.try_divide(xy - F.try_divide(x * y, n), F.sqrt(spread_x) * F.sqrt(spread_y))
    return F.when(odd > 0, float("nan")).when(varies, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _cells(columns: list[str]) -> Column:
    names = F.array(*[F.lit(c) for c in columns])
    places = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    return F.transform(places, lambda j: F.struct(F.element_at(names, j + 1).alias("feature_b"), _corr(F.col("sums"), j, len(columns)).alias("corr")))


def pair_correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(feature_a, feature_b, corr) for every column of `left` with every one of `right`.

    Null where fewer than two rows know both, or either does not vary over
    them; NaN where one of their values is infinite or NaN. One scan for up to
    1,000 columns a side, one per pair of tiles beyond.
    """
    out = None
    for i in range(0, len(left), TILE):
        for k in range(0, len(right), TILE):
            rows, columns = left[i : i + TILE], right[k : k + TILE]
            names = F.array(*[F.lit(c) for c in rows])
            part = pair_sums(df, rows, columns).select(F.element_at(names, F.col("at") + 1).alias("feature_a"), F.inline(_cells(columns)))
            same = F.col("feature_a") == F.col("feature_b")
            part = part.withColumn("corr", F.when(same & F.col("corr").isNotNull() & ~F.isnan("corr"), 1.0).otherwise(F.col("corr")))
            out = part if out is None else out.unionByName(part)
    return out
