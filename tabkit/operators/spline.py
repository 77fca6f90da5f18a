"""Curvature of a not-a-knot cubic spline, solved in overlapping blocks of knots.

The second derivatives at the knots solve one tridiagonal system per entity.
Its rows are diagonally dominant by a factor of two whatever the spacing, so
the influence of a knot at least halves with every knot in between. A block
solved with 64 extra knots on either side therefore agrees with the whole
system to the last bit of a double, and blocks can be solved apart. Only blocks
that touch a gap are solved: curvature is asked for at the two ends of a gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.operators.ordered import NumberedRows, null_safe_join, number_rows, with_totals
from tabkit.session import small_side

BLOCK_KNOTS = 4096
HALO_KNOTS = 64


def _second_derivatives(x: np.ndarray, y: np.ndarray, real_start: bool, real_end: bool) -> np.ndarray:
    """Second derivatives at the knots; an end cut off by the block is taken as straight."""
    n = len(x)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    diag = 2.0 * (h[:-1] + h[1:])
    lower, upper = h[:-1].copy(), h[1:].copy()
    right = 6.0 * np.diff(slope)
    if real_start:
        diag[0] += h[0] * (h[0] + h[1]) / h[1]
        upper[0] -= h[0] * h[0] / h[1]
    if real_end:
        diag[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
        lower[-1] -= h[-1] * h[-1] / h[-2]
    k = n - 2
    d, r = diag.tolist(), right.tolist()
    lo, up = lower.tolist(), upper.tolist()
    for i in range(1, k):
        f = lo[i] / d[i - 1]
        d[i] -= f * up[i - 1]
        r[i] -= f * r[i - 1]
    inner = [0.0] * k
    inner[-1] = r[-1] / d[-1]
    for i in range(k - 2, -1, -1):
        inner[i] = (r[i] - up[i] * inner[i + 1]) / d[i]
    m = np.zeros(n)
    m[1:-1] = inner
    if real_start:
        m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    if real_end:
        m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    return m


def knot_curvature(
    rows: NumberedRows, value: Column, max_rows: int | None,
    block_knots: int = BLOCK_KNOTS, halo_knots: int = HALO_KNOTS,
) -> DataFrame:
    """(keys, position, _m) for the non-null rows in blocks with a gap, of entities with at least four such rows."""
    keys, pos = rows.keys, rows.pos
    known = rows.df.select(*keys, pos, value.alias("_y")).filter(F.col("_y").isNotNull())
    numbered = number_rows(known, keys, [pos], "_k", max_rows)
    knots = with_totals(numbered.df, keys, {"_size": F.count(F.lit(1))}, numbered.split).filter("_size >= 4")

    k = F.col("_k")
    last_block = F.floor((F.col("_size") - 1) / F.lit(block_knots))
    first = F.floor(F.greatest(k - halo_knots, F.lit(0)) / F.lit(block_knots))
    last = F.least(F.floor((k + halo_knots) / F.lit(block_knots)), last_block)
    # unknown rows before the knot: a block meets a gap where this changes within it or towards a neighbour
    before, beside = F.floor(F.greatest(k - 1, F.lit(0)) / F.lit(block_knots)), F.floor((k + 1) / F.lit(block_knots))
    near = knots.withColumn("_block", F.explode(F.sequence(before, F.least(beside, last_block))))
    missed = F.col(pos) - k
    gaps = near.groupBy(*keys, "_block").agg(F.min(missed).alias("_lo"), F.max(missed).alias("_hi")).filter("_lo < _hi")
    copies = knots.withColumn("_block", F.explode(F.sequence(first, last)))
    copies = null_safe_join(copies, small_side(gaps.select(*keys, "_block")), [*keys, "_block"], "left_semi")

    by = [*keys, "_block"]
    schema = T.StructType(
        [f for f in copies.schema if f.name in keys or f.name == pos] + [T.StructField("_m", T.DoubleType())]
    )

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_k")
        k = block["_k"].to_numpy()
        m = _second_derivatives(
            block[pos].to_numpy(float), block["_y"].to_numpy(float),
            k[0] == 0, k[-1] == block["_size"].iloc[0] - 1,
        )
        own = k // block_knots == block["_block"].iloc[0]
        return block.assign(_m=m).loc[own, [*keys, pos, "_m"]]

    return copies.groupBy(*by).applyInPandas(solve, schema)
