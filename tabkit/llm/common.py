"""What several operators of this folder share."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.session import small_side, stable

#: Words are runs of anything but ASCII white space; lower case means A-Z only.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a column __row, a long that names each row and is the same on every reading.

    It is the hash of the file's path, with the row's position in the file mixed
    into the low bits: two of a million files of 100,000 rows clash with a
    chance below one in a hundred. A frame that doesn't read files directly is
    first written to the shared folder, which fixes its rows.
    """
    place = F.xxhash64("_metadata.file_path").bitwiseXOR(F.col("_metadata.row_index"))
    try:
        return docs.select("*", place.alias("__row"))
    except AnalysisException:
        return stable(docs).select("*", place.alias("__row"))


def ranked(rows: DataFrame, group: str, order: list[str], per_part: int = 500_000) -> DataFrame:
    """`rows` with __rank, the position from 1 within the group (null is a group) by `order`.

    A group may hold any share of the rows: they are range-partitioned by group
    and order, written so that a repeated task sees the same ranges, numbered
    within each range, and shifted by the counts of the ranges before. Rows
    that tie in every order column are interchangeable.
    """
    rows = stable(rows)
    parts = parts_for(rows.count(), per_part)
    placed = stable(rows.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = placed.withColumn("__k", F.row_number().over(W.partitionBy("__part", group).orderBy(*order)))
    joined = within.join(small_side(shifts), (F.col("__part") == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("__rank", F.col("__k") + F.col("__before")).drop("__part", "__at", "__group", "__k", "__before")


def parts_for(rows: int, per_part: int, least: int = 12) -> int:
    """Shuffle partitions so that each holds about `per_part` rows."""
    return max(least, -(-rows // per_part))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b), any order, repeats allowed.

    Returns one row (node, component) per node of an edge that is not itself
    its component's smallest node. Alternates large-star and small-star rounds:
    every round is two aggregations with map-side combining and two joins on
    slim rows, written to the shared folder, and rounds grow with the logarithm
    of the longest path. Nothing is collected but a count and a checksum.
    """
    pairs = stable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    last = _state(pairs)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stable(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(pairs)
        if now == last:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes, given edges between index arrays a and b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        if not keep.any() or np.array_equal(before, label):
            break
    return label
