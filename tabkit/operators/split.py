"""Stratified splits and fold numbers that repeat for a given seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.operators.ordered import MAX_ROWS, null_safe_join, number_rows, partition, with_totals
from tabkit.session import small_side

PREFIX = 5  # hex digits: about a million hash ranges per stratum


def row_hash(row_id: str, seed: int) -> Column:
    """Hex digest that stands in for a random draw; the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def hash_split(df: DataFrame, row_id: str, test_share: float, seed: int = 6) -> DataFrame:
    """Train/test role from the hash alone: no shuffle, the share holds approximately in every stratum."""
    draw = F.conv(F.substring(row_hash(row_id, seed), 1, 8), 16, 10).cast("double") / 2**32
    return df.withColumn("role", F.when(draw < test_share, "test").otherwise("train"))


def stratum_sizes(counts: DataFrame, strata: list[str], test_share: float) -> DataFrame:
    """Test rows per stratum: train sizes by largest remainder, the rest is test."""
    everything = W.partitionBy(F.lit(0))  # one row per stratum
    total = F.sum("_n").over(everything)
    n_train = total - F.ceil(total * F.lit(test_share))
    exact = n_train * F.col("_n") / total
    spare = n_train - F.sum(F.floor(exact)).over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("_rest"), *strata))
    return (
        counts.withColumns({"_floor": F.floor(exact), "_rest": exact - F.floor(exact), "_spare": spare})
        .withColumn("_train", F.col("_floor") + F.when(place <= F.col("_spare"), 1).otherwise(0))
        .select(*strata, (F.col("_n") - F.col("_train")).alias("_test"))
    )


def stratified_split(
    df: DataFrame, row_id: str, strata: list[str], test_share: float = 0.33, seed: int = 6
) -> DataFrame:
    """Exact train/test split: in every stratum the rows with the smallest hashes are test.

    Only the hash that bounds the test part has to be found, so the rows are
    never sorted: they are counted by hash prefix, and just the one range that
    holds the boundary is ranked. Its size is a millionth of the stratum.
    `row_id` must identify a row.
    """
    rows = df.select(*strata, row_hash(row_id, seed).alias("_h")).withColumn("_p", F.substring("_h", 1, PREFIX))
    counts = rows.groupBy(*strata, "_p").agg(F.count(F.lit(1)).alias("_n"))
    sizes = stratum_sizes(counts.groupBy(*strata).agg(F.sum("_n").alias("_n")), strata, test_share)
    upto = F.sum("_n").over(partition(strata).orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    boundary = small_side(
        null_safe_join(counts.withColumn("_upto", upto), sizes, strata, "inner")
        .filter((F.col("_upto") >= F.col("_test")) & (F.col("_upto") - F.col("_n") < F.col("_test")))
        .select(*strata, "_p", (F.col("_test") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    last = small_side(
        null_safe_join(rows, boundary, [*strata, "_p"], "inner")
        .withColumn("_rank", F.row_number().over(partition(strata).orderBy("_h")))
        .filter(F.col("_rank") == F.col("_take"))
        .select(*strata, F.col("_h").alias("_last"))
    )
    role = F.when(row_hash(row_id, seed) <= F.col("_last"), "test").otherwise("train")
    return null_safe_join(df, last, strata).withColumn("role", role).drop("_last")


def contiguous_folds(
    df: DataFrame, order: list[str], k: int, fold: str = "fold", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Fold 0..k-1 in consecutive blocks along `order`; the first n mod k blocks have one row more."""
    rows = number_rows(df, [], order, max_rows=max_rows)
    sized = with_totals(rows.df, [], {"_n": F.count(F.lit(1))}, rows.split)
    pos, n = F.col(rows.pos), F.col("_n")
    small, larger = F.floor(n / F.lit(k)), n % k
    edge = larger * (small + 1)
    number = F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(
        larger + F.floor((pos - edge) / F.greatest(small, F.lit(1)))
    )
    return sized.withColumn(fold, number.cast("int")).drop(rows.pos, "_n")


def stratified_folds(
    df: DataFrame, label: str, order: list[str], k: int, fold: str = "fold", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Fold 0..k-1 in consecutive blocks inside each class, class shares alike in all folds.

    Block sizes are those of dealing the rows, sorted by class, to the folds in turn.
    Classes count in the order of their first row.
    """
    rows = number_rows(df, [label], order, max_rows=max_rows)
    classes = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first")
    )
    earlier = W.partitionBy(F.lit(0)).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.withColumn("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_first")
    joined = null_safe_join(rows.df, small_side(classes), [label], "inner")

    s, n, pos = F.col("_s"), F.col("_n"), F.col(rows.pos)

    def dealt(i: int) -> Column:
        return F.floor((s + n - 1 - i) / F.lit(k)) - F.floor((s - 1 - i) / F.lit(k))

    number, end = F.lit(0), F.lit(0)
    for i in range(k - 1):
        end = end + dealt(i)
        number = number + F.when(pos >= end, 1).otherwise(0)
    return joined.withColumn(fold, number.cast("int")).drop(rows.pos, "_s", "_n")
