"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target /
source size. Within the source the documents stand in order of size; the
expected copies are summed along that order, one offset in [0, 1) is added, and
a document is emitted once per integer its interval crosses. The order makes
neighbours alike, so what a source yields misses its target by less than its
largest document, whatever the offset. Nobody gets more than ceil(rate) copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import SPACES, numbered, ranked

WEIGHTS = (5, 2, 1)
MOST = 3.0
SEED = 42


def words(text: str = "text"):
    """Number of words of a column; a null text has none."""
    trimmed = F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), f"^{SPACES}|{SPACES}$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def source_targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Target of each source: all words shared by weight, none above `most` times its own.

    Sources take the weights in code point order, null last. What a capped
    source cannot take is shared again among the others by weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, targets, open_names = float(sum(sizes.values())), {}, names
    while open_names:
        left = total - sum(targets.values())
        per_weight = left / sum(weight[s] for s in open_names)
        over = [s for s in open_names if per_weight * weight[s] > most * sizes[s]]
        if not over:
            targets |= {s: per_weight * weight[s] for s in open_names}
            break
        targets |= {s: most * sizes[s] for s in over}
        open_names = [s for s in open_names if s not in targets]
    return targets


def plan_mix(rows: DataFrame, seed: int = SEED, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """`rows` (source, size, a column that orders ties, and any others) with source_size, target and copies.

    The driver sees one sum per source. Rows equal in every column are
    interchangeable; a source without words, and an empty table, take nothing.
    """
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = {r["source"]: r["source_size"] for r in per_source.collect()}
    targets = source_targets(sizes, weights, most)
    schema = T.StructType([T.StructField("__source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    known = rows.sparkSession.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], schema)
    order = ["size", *(c for c in rows.columns if c not in ("source", "size"))]
    placed = ranked(rows, "source", order).join(F.broadcast(known), F.col("source").eqNullSafe(F.col("__source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # 53 bits of a hash: the same offset on every run
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("\0null"))), 11) / F.lit(float(1 << 53))
    crossed = F.floor(F.col("__rank") * rate + offset) - F.floor((F.col("__rank") - 1) * rate + offset)
    # at a rate of exactly `most`, rounding must not add a copy
    copies = F.least(crossed, F.lit(int(-(-most // 1)))).cast("long")
    return placed.withColumn("copies", copies).drop("__source", "__rank")


def mix_documents(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """The mix itself: every document as often as it was drawn, with the columns of `docs`.

    Size is the number of words (null text: 0). A null source is a source of
    its own, empty texts count no words but may be drawn, repeated rows are
    drawn one by one, and an empty table stays empty. Names of columns don't
    matter beyond doc_id, text and source; __row is reserved.
    """
    whole = numbered(docs)
    plan = plan_mix(whole.select("source", words().alias("size"), "doc_id", "__row"), seed, weights, most)
    drawn = plan.where("copies > 0").select(F.col("__row").alias("__drawn"), F.sequence(F.lit(1).cast("long"), "copies").alias("__copies"))
    repeated = whole.join(drawn, F.col("__row") == F.col("__drawn")).withColumn("__copy", F.explode("__copies"))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
