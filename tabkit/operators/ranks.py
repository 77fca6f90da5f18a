"""Values at given ranks of groups of any size, by narrowing the cell that holds each rank.

Every round is one aggregate with map-side combining: rows of a cell are
counted by sub-cell, with each sub-cell's smallest and largest value, and of
each cell only the sub-cell that holds the rank is looked at again. The first
round cuts by sign and power of two, so values of any spread are cut evenly;
later ones cut a cell into equal parts between its ends. A rank is found when
its cell holds one value, or when it is the first or last of its cell. Once few
rows are left in the cells, each value is a cell of its own. What is shuffled
is counts per cell and task, never the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.operators.ordered import null_safe_join
from tabkit.session import BROADCAST_BYTES, BROADCAST_ROWS, stable

CELLS = 4096
#: Rows left in all cells from which on every value is a cell.
FEW_ROWS = 100_000


def _power_of_two(v: Column) -> Column:
    """Grows with v: sign and binary exponent; infinities lie outside all finite values."""
    size = F.when(F.abs(v) == float("inf"), 3000).otherwise(F.floor(F.log2(F.abs(v))).cast("int") + 1100)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("double")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Equal parts between the ends; rounding never swaps two values, as every step grows with v."""
    share = (v - low) / (high - low)  # of one sign and power of two, so the width is finite and not 0
    return F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("double")


def values_at_ranks(rows: DataFrame, keys: list[str], targets: DataFrame, value: str = "_v", few: int = FEW_ROWS) -> DataFrame:
    """(keys, _rank, _value): the value at each 0-based rank among the group's rows, smallest first.

    `rows` holds keys and a double that is neither null nor NaN; `targets` keys
    and _rank. Reads `rows` once per round, seven rounds at most as a cell shrinks
    4,096 times in each; three are usual.
    """
    v = F.col(value)
    everything = {"_before": F.lit(0).cast("long"), "_low": F.lit(float("-inf")), "_high": F.lit(float("inf"))}
    state = stable(targets.select(*keys, "_rank").distinct().withColumns(everything))
    open_targets, cell, found = state, _power_of_two(v), None
    while True:
        key_bytes = F.length(F.to_json(F.struct(*keys, "_low", "_high")))
        size = open_targets.agg(F.count(F.lit(1)).alias("n"), F.sum(key_bytes).alias("bytes")).first()
        if not size["n"]:
            break
        fits = size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES

        def sent(df: DataFrame, fits: bool = fits) -> DataFrame:
            return F.broadcast(df) if fits else df

        cells = open_targets.select(*keys, "_low", "_high").distinct()
        renamed = cells.withColumnsRenamed({k: f"_cell_{k}" for k in keys})
        match = (v >= F.col("_low")) & (v <= F.col("_high"))
        for k in keys:
            match = F.col(k).eqNullSafe(F.col(f"_cell_{k}")) & match
        inside = rows.join(sent(renamed), match).drop(*[f"_cell_{k}" for k in keys])
        counted = inside.groupBy(*keys, "_low", "_high", cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(v).alias("_first"), F.max(v).alias("_last")
        )
        earlier = W.partitionBy(*keys, "_low", "_high").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
        counted = counted.withColumn("_skipped", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        asked = sent(open_targets.select(*keys, "_rank", "_before", "_low", "_high"))
        placed = null_safe_join(counted, asked, [*keys, "_low", "_high"], "inner")
        start = F.col("_before") + F.col("_skipped")
        placed = placed.filter((F.col("_rank") >= start) & (F.col("_rank") < start + F.col("_n")))
        known = (
            F.when((F.col("_first") == F.col("_last")) | (F.col("_rank") == F.col("_before")), F.col("_first"))
            .when(F.col("_rank") == F.col("_before") + F.col("_n") - 1, F.col("_last"))
        )
        placed = placed.select(*keys, "_rank", start.alias("_before"), "_n", "_first", "_last").withColumn("_value", known)
        placed = stable(placed)
        done = placed.filter("_value is not null").select(*keys, "_rank", "_value")
        found = done if found is None else found.unionByName(done)
        open_targets = placed.filter("_value is null").withColumnsRenamed({"_first": "_low", "_last": "_high"})
        left = open_targets.select(*keys, "_low", "_high", "_n").distinct().agg(F.sum("_n")).first()[0]
        cell = v if left is not None and left <= few else _part(v, F.col("_low"), F.col("_high"))
    return found if found is not None else state.select(*keys, "_rank", F.lit(None).cast("double").alias("_value"))
