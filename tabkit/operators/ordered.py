"""Row order inside groups that may be far too large for one task.

Row numbers, running sums, fills and centred windows all need the rows of a
group in order. A plain window sends each group to one task, which fails once
a single group holds a large share of the table. Where some group is above a
row limit, the table is range-partitioned once by group and order, sorted
within its ranges and written, with each row's range and a number that grows
along the whole table. A window then works per group and range, on that
number, and what a range needs to know of those before it is its *carry*: one
row per range of a group, scanned along the ranges and joined back. A range
boundary lies in one group at most, so there are fewer carries than ranges.

Groups below the limit take the plain window; only a count per group is added.
Pass ``max_rows=None`` when the group size is bounded by construction, for
instance one row per group and calendar day straight out of a ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.session import small_side, stable

MAX_ROWS = 250_000
#: Ranges at most: beyond 1.25 billion rows they hold more than the row limit, and windows spill.
MAX_RANGES = 10_000
#: Sort keys per range that Spark samples for the bounds, and in all: it brings up to three times as many to the driver.
RANGE_SAMPLE, MAX_SAMPLE = 100, 100_000

RANGE, AT, ROW = "_range", "_at", "_row"


def partition(keys: list[str]):
    """Partition spec that stays explicit when there is no key."""
    return W.partitionBy(*(keys or [F.lit(0)]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_right_{k}" for k in keys])


def split_hot(
    df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = MAX_ROWS, derived: bool = False
) -> tuple[DataFrame, list[str]]:
    """Lay the table out in ranges along `keys` and `order` if some group is above `max_rows`.

    Returns the rows with their range and a number that grows along the whole
    order, and the name of the range column in a list; an empty list means that
    no group was above the limit and nothing was done. The layout is written to
    the shared folder, so a recomputed task finds every row where it was. Nulls
    come first; any type that sorts will do; rows that tie in every column share
    a range. Ranges hold half the limit on average, by sampled bounds. Sampling
    reads the rows once more: say `derived=True` when they come out of a shuffle
    that should not be repeated.
    """
    if max_rows is None:
        return df, []
    largest, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if largest is None or largest <= max_rows:
        return df, []
    ranges = max(2, min(MAX_RANGES, -(-2 * total // max_rows)))
    sort = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    rows = (stable(df) if derived else df).repartitionByRange(ranges, *sort).sortWithinPartitions(*sort)
    with _sampled(df.sparkSession, max(1, min(RANGE_SAMPLE, MAX_SAMPLE // ranges))):
        return stable(rows.withColumns({RANGE: F.spark_partition_id(), AT: F.monotonically_increasing_id()})), [RANGE]


@contextmanager
def _sampled(spark: SparkSession, per_range: int):
    """Range bounds come from so many sampled rows per range within the block."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, str(per_range))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def carried(laid: DataFrame, keys: list[str], own: dict[str, Column], scan: Callable = F.sum) -> DataFrame:
    """Add, per name, what `scan` makes of the aggregate over the earlier ranges of the row's group.

    Null in the first range of a group. Carries exist only from the second
    range of a group on, so there are fewer of them than ranges.
    """
    before = partition(keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    per_range = laid.groupBy(*keys, RANGE).agg(*[a.alias(name) for name, a in own.items()])
    scanned = per_range.withColumns({name: scan(name).over(before) for name in own} | {"_nth": F.count(F.lit(1)).over(before)})
    return null_safe_join(laid, small_side(scanned.filter("_nth > 0").drop("_nth")), [*keys, RANGE])


def last_known(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add the last non-null value of each expression up to the row, in its group."""
    laid, ranges = split_hot(df, keys, order, max_rows)
    if not ranges:
        w = partition(keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, 0)
        return laid.withColumns({o: F.last(v, ignorenulls=True).over(w) for o, v in values.items()})
    inputs = {f"_in_{o}": v for o, v in values.items()}
    laid = laid.withColumns(inputs)
    ends = {f"_carry_{o}": F.max_by(f"_in_{o}", F.when(F.col(f"_in_{o}").isNotNull(), F.col(AT))) for o in values}
    laid = carried(laid, keys, ends, lambda c: F.last(c, ignorenulls=True))
    w = partition(keys + ranges).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    found = {o: F.coalesce(F.last(f"_in_{o}", ignorenulls=True).over(w), F.col(f"_carry_{o}")) for o in values}
    return laid.withColumns(found).drop(*inputs, *ends, RANGE, AT)


def with_totals(df: DataFrame, keys: list[str], totals: dict[str, Column], split: bool) -> DataFrame:
    """Add aggregates over each row's group.

    Small groups use a window on the partitioning already there; if some are
    above the limit, an aggregate with partial sums is joined back instead.
    """
    if not split:
        return df.withColumns({n: a.over(partition(keys)) for n, a in totals.items()})
    few = small_side(df.groupBy(*keys).agg(*[a.alias(n) for n, a in totals.items()]))
    if keys:
        return null_safe_join(df, few, keys, "inner")
    row = few.first()
    return df.withColumns({n: F.lit(row[n]) for n in totals})


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    max_rows: int | None = MAX_ROWS,
    totals: dict[str, Column] | None = None,
    derived: bool = False,
) -> DataFrame:
    """Add running totals (up to and including the row) of the given expressions.

    `totals` names aggregates over the whole group to add as well.
    """
    inputs = {f"_in_{out}": expr for out, expr in sums.items()}
    laid, buckets = split_hot(df.withColumns(inputs), keys, order, max_rows, derived)
    sort = [F.col(c).asc_nulls_first() for c in order]
    if totals:
        laid = with_totals(laid, keys, totals, bool(buckets))
    if not buckets:
        w = partition(keys).orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
        return laid.withColumns({o: F.sum(f"_in_{o}").over(w) for o in sums}).drop(*inputs)

    earlier = {f"_carry_{o}": F.sum(f"_in_{o}") for o in sums}
    w = partition(keys + buckets).orderBy(AT).rowsBetween(W.unboundedPreceding, 0)
    running = {
        o: F.when(F.col(f"_carry_{o}").isNull(), F.sum(f"_in_{o}").over(w))
        .otherwise(F.col(f"_carry_{o}") + F.coalesce(F.sum(f"_in_{o}").over(w), F.lit(0)))
        for o in sums
    }
    return carried(laid, keys, earlier).withColumns(running).drop(*inputs, *earlier, RANGE, AT)


@dataclass
class NumberedRows:
    """Rows with a dense 0-based position inside their group.

    `split` tells whether some group is above the limit; then windows run on
    blocks of consecutive positions, which are even by construction.
    """

    df: DataFrame
    keys: list[str]
    order: list[str]
    pos: str
    split: bool
    block_rows: int

    def window(self, reverse: bool = False):
        """Whole-group order, for the case that no group is above the limit."""
        sort = [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_first() for c in self.order]
        return partition(self.keys).orderBy(*sort)

    def replace(self, df: DataFrame) -> NumberedRows:
        return NumberedRows(df, self.keys, self.order, self.pos, self.split, self.block_rows)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], pos: str = "_pos", max_rows: int | None = MAX_ROWS,
    derived: bool = False,
) -> NumberedRows:
    """Number the rows of each group 0, 1, 2, ... along `order` (which must have no ties).

    Numbers that took bucket-wise work are written out, as what follows reads them more than once.
    """
    laid, buckets = split_hot(df, keys, order, max_rows, derived)
    rows = NumberedRows(laid, keys, order, pos, bool(buckets), max_rows or MAX_ROWS)
    if not buckets:
        return rows.replace(laid.withColumn(pos, F.row_number().over(rows.window()) - F.lit(1).cast("long")))

    w = partition(keys + buckets).orderBy(AT)
    place = F.coalesce("_carry", F.lit(0)) + F.row_number().over(w) - F.lit(1).cast("long")
    numbered = carried(laid, keys, {"_carry": F.count(F.lit(1))}).withColumn(pos, place)
    return rows.replace(stable(numbered.drop("_carry", RANGE, AT)))


def nearest_values(
    rows: NumberedRows, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None
) -> NumberedRows:
    """Per row the last non-null value up to it (`before`) and the next one from it on (`after`).

    Both directions share one shuffle. Looking ahead is looking back in the
    reversed order: a frame that reaches to the end of its group would be
    evaluated anew for every row.
    """
    before, after = before or {}, after or {}
    if not rows.split:
        up, down = (w.rowsBetween(W.unboundedPreceding, 0) for w in (rows.window(), rows.window(reverse=True)))
        found = {o: F.last(v, ignorenulls=True).over(up) for o, v in before.items()}
        found |= {o: F.last(v, ignorenulls=True).over(down) for o, v in after.items()}
        return rows.replace(rows.df.withColumns(found))

    pos, keys = F.col(rows.pos), rows.keys
    ins_b = {f"_b_{o}": v for o, v in before.items()}
    ins_a = {f"_a_{o}": v for o, v in after.items()}
    data = rows.df.withColumns(
        {**ins_b, **ins_a, "_block": F.floor(pos / F.lit(rows.block_rows)), ROW: F.lit(1)}
    )

    def known_at(c):
        return F.when(F.col(c).isNotNull(), pos)

    # one row per block: the block's own last and first known values
    ends = data.groupBy(*keys, "_block").agg(
        *[F.max_by(c, known_at(c)).alias(c) for c in ins_b], *[F.min_by(c, known_at(c)).alias(c) for c in ins_a]
    )
    earlier, later = (
        partition(keys).orderBy(c).rowsBetween(W.unboundedPreceding, -1) for c in ("_block", F.desc("_block"))
    )
    ends = ends.withColumns(
        {c: F.last(c, ignorenulls=True).over(earlier) for c in ins_b}
        | {c: F.last(c, ignorenulls=True).over(later) for c in ins_a}
    )
    # the first seed of a block carries what came before it, the last what follows
    both = data
    for row, columns in ((0, list(ins_b)), (2, list(ins_a))):
        if columns:
            seeds = ends.select(*keys, "_block", *columns, F.lit(row).alias(ROW))
            both = both.unionByName(seeds, allowMissingColumns=True)
    w = partition(keys + ["_block"])
    up, down = (
        w.orderBy(*sort).rowsBetween(W.unboundedPreceding, 0)
        for sort in ((ROW, rows.pos), (F.desc(ROW), F.desc(rows.pos)))
    )
    found = {o: F.last(f"_b_{o}", ignorenulls=True).over(up) for o in before}
    found |= {o: F.last(f"_a_{o}", ignorenulls=True).over(down) for o in after}
    return rows.replace(both.withColumns(found).filter(F.col(ROW) == 1).drop(*ins_b, *ins_a, "_block", ROW))


def neighbourhood(rows: NumberedRows, before: int, after: int, results) -> NumberedRows:
    """Columns that look at most `before` rows back and `after` rows ahead.

    `results` maps an ordered window spec to {name: Column}. In a split layout
    the rows near a block's edge are also sent to the neighbouring block.
    """
    if not rows.split:
        return rows.replace(rows.df.withColumns(results(rows.window())))
    size = max(rows.block_rows, before + after + 1)
    pos = F.col(rows.pos)
    home = F.floor(pos / F.lit(size))
    # a row reaches the blocks of every row whose frame covers it
    first = F.floor(F.greatest(pos - after, F.lit(0)) / F.lit(size))
    span = F.sequence(first, F.floor((pos + before) / F.lit(size)))
    data = rows.df.withColumn("_home", home).withColumn("_block", F.explode(span))
    w = partition(rows.keys + ["_block"]).orderBy(rows.pos)
    out = data.withColumns(results(w)).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")
    return rows.replace(out)
