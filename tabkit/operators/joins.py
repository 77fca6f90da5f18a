"""Key joins, outer combination, and date-offset lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join; Spark picks the strategy from measured sizes and splits skewed keys."""
    return left.join(right, [keys] if isinstance(keys, str) else list(keys), how)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, "inner")


def combine_first(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both tables; a null on the left takes the value on the right."""
    l_cols, r_cols = left.columns, right.columns
    values = [c for c in l_cols + [c for c in r_cols if c not in l_cols] if c not in keys]
    r = right.withColumnsRenamed({c: f"_right_{c}" for c in r_cols if c not in keys})
    joined = left.join(r, keys, "full_outer")

    def value(c):
        sides = [F.col(n) for n, cols in ((c, l_cols), (f"_right_{c}", r_cols)) if c in cols]
        return F.coalesce(*sides).alias(c)

    return joined.select(*keys, *[value(c) for c in values])


def append_columns(left: DataFrame, right: DataFrame, keys: list[str], assign: bool = False) -> DataFrame:
    """Columns of both tables side by side by key; `assign` keeps the left keys only."""
    return left.join(right, keys, "left" if assign else "full_outer")


def key_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found in one table only, with the side they are on; a null key matches a null key."""
    counted = _key_counts(left, right, keys).filter((F.col("n_left") == 0) | (F.col("n_right") == 0))
    return counted.select(*keys, F.when(F.col("n_right") == 0, "left").otherwise("right").alias("side"))


def _key_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key on either side: one scan and one partial count per table, one shuffle of keys."""
    sides = left.select(*keys, F.lit(1).alias("n_left"), F.lit(0).alias("n_right")).unionByName(
        right.select(*keys, F.lit(0).alias("n_left"), F.lit(1).alias("n_right"))
    )
    # a group holds null keys together, which an equi-join would not
    return sides.groupBy(*keys).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def key_fingerprint(df: DataFrame, keys: list[str]) -> tuple:
    """Row count and two sums of key hashes: equal for equal keys in equal numbers of rows, in whatever order.

    One aggregate that adds up in the tasks; no key is shuffled. Two different
    tables agree by chance about once in 2^128 comparisons.
    """
    # null flags keep (null, 1) apart from (1, null), whose values hash alike
    parts = [*[F.col(k).isNull() for k in keys], *[F.col(k) for k in keys]]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(df.agg(F.count(F.lit(1)), *sums).first())


def assert_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Raise unless both tables hold the same keys, each in the same number of rows.

    Equal fingerprints settle it with one scan per table; the keys themselves
    are compared only where fingerprints or column types differ.
    """
    types = [[dict(df.dtypes).get(k) for k in keys] for df in (left, right)]
    if types[0] == types[1] and key_fingerprint(left, keys) == key_fingerprint(right, keys):
        return
    odd = _key_counts(left, right, keys).filter("n_left <> n_right").take(10)
    alone = [tuple(r)[:-2] + ("right" if not r["n_left"] else "left",) for r in odd if not (r["n_left"] and r["n_right"])]
    if alone:
        raise ValueError(f"keys on one side only: {sorted(alone, key=str)}")
    if odd:
        raise ValueError(f"row counts differ: {sorted((tuple(r) for r in odd), key=str)}")


def date_lags(
    df: DataFrame,
    date: str,
    value: str,
    offsets: dict[str, int],
    entity: list[str] | None = None,
    tie_break: str | None = None,
) -> DataFrame:
    """Value of `value` exactly N days earlier, one column per named offset; null if that date is absent.

    Every row is sent once per offset to the date that looks it up, folded to
    one row per (entity, date), and joined back on that pair. No group is
    wider than one date, so a long or popular series does not pile up in a
    task. With `entity=[]` the lookup is by date alone. If several rows share
    the date, the one with the largest `tie_break` counts, else the largest value.
    """
    entity = ["city"] if entity is None else entity
    rank = F.col(tie_break or value)
    # fold rows of one (entity, date) first: the lookup needs one value for it
    known = df.filter(F.col(date).isNotNull()).groupBy(*entity, date).agg(F.max_by(value, rank).alias("_value"))
    targets = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), F.lit(n).alias("days")) for name, n in offsets.items()])
    )
    looked_up = (
        known.select(*entity, date, "_value", targets.alias("_t"))
        .select(*entity, F.date_add(date, F.col("_t.days")).alias(date), F.col("_t.name").alias("_name"), "_value")
        .groupBy(*entity, date)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in offsets])
    )
    return df.join(looked_up, [*entity, date], "left")
