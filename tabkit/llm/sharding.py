"""Sharding by sampled splitters: shards of near equal bytes, equal texts together.

A key is the hash of the text, so copies share one key. A size-weighted sample
of keys gives quantile boundaries for many more ranges than shards; a key that
fills several quantiles gets a range of its own. The exact bytes of every range
are then counted, ranges too full for even shards are subdivided, and the
ranges are dealt to the shards, largest first, each to the emptiest shard. A
group of equal texts is cut only if it alone exceeds a quarter of a shard.

The text is read once, for hash, checksum and length; all the rest works on
slim rows. The driver sees the sample and one count per range, both set by the
number of ranges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tabkit.llm.common import numbered
from tabkit.session import stable

SHARDS = 16
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32
ROWS_PER_PIECE = 1_000_000


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> tuple[np.ndarray, set[int]]:
    """Lower ends of the ranges, and the keys that have a range of their own."""
    if not len(keys):
        return np.array([], np.int64), set()
    order = np.argsort(keys, kind="stable")
    keys, reach = keys[order], np.cumsum(weights[order])
    cuts = keys[np.searchsorted(reach, reach[-1] * np.arange(1, ranges) / ranges).clip(max=len(keys) - 1)]
    found, times = np.unique(cuts, return_counts=True)
    alone = found[times > 1]
    after = alone[alone < np.iinfo(np.int64).max] + 1
    return np.unique(np.concatenate([found, after])), set(alone.tolist())


def deal(sizes: list[int], shards: int) -> list[int]:
    """A shard for each size: the largest first, each to the emptiest shard."""
    heap, to = [(0, s) for s in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        filled, shard = heapq.heappop(heap)
        to[i] = shard
        heapq.heappush(heap, (filled + sizes[i], shard))
    return to


def plan_shards(rows: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """`rows` (key long, size long, doc_id, others) with shard and slot, gapless from 0 within each shard."""
    rows = stable(rows.withColumn("__seq", F.monotonically_increasing_id()))
    spark, session_rows = rows.sparkSession, rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    n, total = session_rows[0], session_rows[1] or 0
    ranges = max(shards * ranges_per_shard, n // rows_per_piece)
    per_sample = max(1.0, total / (ranges * SAMPLES_PER_RANGE))
    chance = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance * per_sample < F.col("size")).select("key", "size").toPandas()
    cuts, alone = splitters(drawn["key"].to_numpy(np.int64), drawn["size"].clip(lower=per_sample).to_numpy(float), ranges)

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right"))

    rows = rows.withColumn("__range", range_of("key"))
    own_range = {int(np.searchsorted(cuts, key, side="right")) for key in alone}
    counted = {r[0]: (r[1], r[2]) for r in rows.groupBy("__range").agg(F.count(F.lit(1)), F.sum("size")).collect()}
    most = max(1.0, total / shards / 4)
    # a range of one key can only be cut through its copies, any other between texts
    cut = {r: (-(-int(size) // int(most)), "row" if r in own_range else "key") for r, (_, size) in counted.items() if size > most}
    units = _in_units(rows, cut)
    sized = units.groupBy("__range", "__unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    listed = sorted(sized.collect(), key=lambda r: (r["__range"], r["__unit"]))
    to = deal([r["size"] for r in listed], shards)
    plan, filled = [], [0] * shards
    for r, shard in zip(listed, to, strict=True):
        plan.append((r["__range"], r["__unit"], shard, filled[shard], -(-r["n"] // rows_per_piece)))
        filled[shard] += r["n"]
    plan = spark.createDataFrame(plan, "__range long, __unit long, shard int, __first long, __pieces long")
    placed = units.join(F.broadcast(plan), ["__range", "__unit"]).withColumn("__piece", F.pmod(F.xxhash64("__seq"), F.col("__pieces")))
    unit = ["__range", "__unit"]
    # a unit too long for one task is numbered in pieces, whose counts shift each other
    pieces = placed.where("__pieces > 1").groupBy(*unit, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*unit).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(*unit, "__piece", F.sum("__n").over(before).alias("__shift"))
    at = F.row_number().over(W.partitionBy(*unit, "__piece").orderBy("key", "doc_id", "__seq")) - 1
    numbered_rows = placed.withColumn("__at", at).join(shifts, [*unit, "__piece"], "left")
    slot = F.col("__first") + F.coalesce("__shift", F.lit(0)) + F.col("__at")
    return numbered_rows.withColumn("slot", slot.cast("long")).drop("__range", "__unit", "__piece", "__pieces", "__first", "__n", "__shift", "__at", "__seq")


def _in_units(rows: DataFrame, cut: dict[int, tuple[int, str]]) -> DataFrame:
    """Rows with __unit, the part of their range that is placed as a whole."""
    schema = T.StructType([T.StructField("__range", T.LongType()), T.StructField("__parts", T.LongType()), T.StructField("__by", T.StringType())])
    listed = rows.sparkSession.createDataFrame([(r, parts, by) for r, (parts, by) in cut.items()], schema)
    joined = rows.join(F.broadcast(listed), "__range", "left")
    # copies are cut by document and position: equal ids may hold a third of the table too
    by = F.when(F.col("__by") == "row", F.xxhash64("doc_id", "__seq")).otherwise(F.xxhash64("key", F.lit("unit")))
    return joined.withColumn("__unit", F.coalesce(F.pmod(by, F.col("__parts")), F.lit(0).cast("long"))).drop("__parts", "__by")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Slim rows of documents for plan_shards: a null text has no bytes, its size is 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """`docs` with shard and slot, which replace columns of those names.

    Null ids and texts are placed like any others, equal texts share a shard
    unless together they exceed a quarter of one, repeated rows get slots of
    their own, and an empty table stays empty. __row is reserved.
    """
    whole = numbered(docs)
    plan = plan_shards(keyed(whole, "doc_id", "__row"), shards).select(F.col("__row").alias("__placed"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return whole.join(plan, F.col("__row") == F.col("__placed")).select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
