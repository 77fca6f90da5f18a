"""One boosted model per entity, for any number of entities, in one job.

Entities are counted first. Those that fit a task are trained side by side
inside their groups; an entity above the limit gets a distributed fit of its
own. The models of small entities are rows of a table, so they can be written,
joined and read again, and scoring them is one more grouped pass.

Trees are grown level by level on binned features by squared error; a missing
value goes to the side that lowers the error more. Rows are put in order before
training, so a model does not depend on how they arrived.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.operators.ordered import null_safe_join
from tabkit.operators.prep import MedianImputer
from tabkit.operators.train import fit_kept, fit_per_entity, histogram_regressor
from tabkit.session import small_side, stable

#: Rows of an entity up to which it is trained inside one task.
GROUP_ROWS = 200_000
BINS, LEAST_LEAF = 255, 1

_TREES = [
    T.StructField("base", T.DoubleType()), T.StructField("which", T.ArrayType(T.IntegerType())), T.StructField("cut", T.ArrayType(T.DoubleType())),
    T.StructField("missing_left", T.ArrayType(T.BooleanType())), T.StructField("leaf", T.ArrayType(T.DoubleType())),
]


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: between all different values, or between quantiles where there are more."""
    known = np.unique(values[~np.isnan(values)])
    if len(known) > bins:
        known = np.unique(np.quantile(values[~np.isnan(values)], np.linspace(0, 1, bins), method="nearest"))
    return known[:-1] + (known[1:] - known[:-1]) / 2


def boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int, bins: int = BINS, least_leaf: int = LEAST_LEAF) -> dict:
    """Trees of one group: per tree and inner node the feature (-1: none), cut and side of the missing; per leaf its value."""
    order = np.lexsort([y, *x.T[::-1]])
    x, y = x[order], y[order]
    n, width = x.shape
    edges = [_edges(x[:, j], bins) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]) if width else np.zeros((n, 0), int)
    missing, inner = np.isnan(x), 2**depth - 1
    base, model = float(y.mean()), {"which": [], "cut": [], "missing_left": [], "leaf": []}
    guess = np.full(n, base)
    for _ in range(rounds):
        wrong, node = y - guess, np.zeros(n, np.int64)
        which, cut, left_missing = np.full(inner, -1), np.zeros(inner), np.ones(inner, bool)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            place = node - first
            gain = np.full(many, 1e-12)
            for j in range(width):
                size = len(edges[j]) + 1
                at = place * (size + 1) + np.where(missing[:, j], size, binned[:, j])
                count, total = (np.bincount(at, w, minlength=many * (size + 1)).reshape(many, size + 1) for w in (None, wrong))
                whole_n, whole = count.sum(axis=1), total.sum(axis=1)
                for side in (True, False):
                    if not side and not count[:, size].any():
                        continue
                    n_left = np.cumsum(count[:, : size - 1], axis=1) + side * count[:, size:]
                    s_left = np.cumsum(total[:, : size - 1], axis=1) + side * total[:, size:]
                    n_right, s_right = whole_n[:, None] - n_left, whole[:, None] - s_left
                    fits = (n_left >= least_leaf) & (n_right >= least_leaf)
                    score = s_left**2 / np.maximum(n_left, 1) + s_right**2 / np.maximum(n_right, 1) - (whole**2 / np.maximum(whole_n, 1))[:, None]
                    score = np.where(fits, score, 0.0)
                    if not score.shape[1]:
                        continue
                    best = score.argmax(axis=1)
                    value = score[np.arange(many), best]
                    better = np.flatnonzero(value > gain * (1 + 1e-9))
                    gain[better] = value[better]
                    which[first + better], cut[first + better], left_missing[first + better] = j, edges[j][best[better]], side
            node = _down(x, missing, node, which, cut, left_missing)
        leaf_at = node - inner
        often, total = np.bincount(leaf_at, minlength=inner + 1), np.bincount(leaf_at, wrong, minlength=inner + 1)
        leaf = rate * total / np.maximum(often, 1)
        guess = guess + leaf[leaf_at]
        for name, values in (("which", which), ("cut", cut), ("missing_left", left_missing), ("leaf", leaf)):
            model[name].append(values)
    return {"base": base, **{k: np.concatenate([*v, []]) for k, v in model.items()}}


def _down(x: np.ndarray, missing: np.ndarray, node: np.ndarray, which: np.ndarray, cut: np.ndarray, left_missing: np.ndarray) -> np.ndarray:
    """Every row's next node; a node without a split sends all to the left."""
    row, j = np.arange(len(node)), which[node]
    value, absent = x[row, np.maximum(j, 0)] if x.shape[1] else cut[node], missing[row, np.maximum(j, 0)] if x.shape[1] else np.zeros(len(node), bool)
    right = np.where(absent, ~left_missing[node], value > cut[node]) & (j >= 0)
    return 2 * node + 1 + right


def predict(model: dict, x: np.ndarray, depth: int) -> np.ndarray:
    inner, missing = 2**depth - 1, np.isnan(x)
    which, cut, left = (np.asarray(model[k]).reshape(-1, inner) for k in ("which", "cut", "missing_left"))
    leaf, guess = np.asarray(model["leaf"]).reshape(-1, inner + 1), np.full(len(x), model["base"])
    for t in range(len(leaf)):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = _down(x, missing, node, which[t].astype(int), cut[t], left[t].astype(bool))
        guess = guess + leaf[t][node - inner]
    return guess


def _matrix(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """The columns as doubles, nulls as NaN."""
    return np.column_stack([rows.column(c).cast(pa.float64()).to_numpy() for c in columns]) if columns else np.zeros((rows.num_rows, 0))


@dataclass
class GroupedModel:
    """Models by entity: `models`, a table, for those trained in groups; `large` for the rest."""

    models: DataFrame
    entity: str
    features: list[str]
    depth: int
    large: dict[object, Model] = field(default_factory=dict)
    group_rows: int = GROUP_ROWS

    def _dealt(self, rows: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides with __part: an entity with many rows to score is dealt to several tasks, each with its model."""
        size = rows.groupBy("__entity").count().filter(F.col("count") > self.group_rows)
        parts = small_side(size.select("__entity", F.ceil(F.col("count") / self.group_rows).cast("int").alias("__parts")))
        if parts.isEmpty():
            return rows.withColumn("__part", F.lit(0)), models.withColumn("__part", F.lit(0))
        many = F.coalesce("__parts", F.lit(1))
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), many).cast("int")
        rows = null_safe_join(rows, parts, ["__entity"]).withColumn("__part", part).drop("__parts")
        copies = null_safe_join(models, parts, ["__entity"]).withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1)))
        return rows, copies.drop("__parts")

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with a prediction; rows of entities without a model are left out. Repeated rows and nulls in features stay."""
        entity, features, depth = self.entity, self.features, self.depth
        names = [f.name for f in _TREES]
        slim = df.select("*", F.col(entity).alias("__entity"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)])
        schema = T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())])
        kept = df.columns

        def scored(rows: pa.Table, models: pa.Table) -> pa.Table:
            if not models.num_rows or not rows.num_rows:
                return pa.Table.from_batches([], schema=rows.select(kept).schema.append(pa.field("prediction", pa.float64())))
            model = {k: models.column(k)[0].as_py() for k in names}
            guess = predict(model, _matrix(rows, [f"__x{i}" for i in range(len(features))]), depth)
            return rows.select(kept).append_column("prediction", pa.array(guess))

        large = list(self.large)
        small = slim
        for e in large:
            small = small.filter(~F.col(entity).eqNullSafe(F.lit(e)))
        small, models = self._dealt(small, self.models.withColumnRenamed(entity, "__entity"))
        by = ["__entity", "__part"]
        out = small.groupBy(*by).cogroup(models.groupBy(*by)).applyInArrow(scored, schema)
        for e in large:
            part = self.large[e].transform(df.filter(F.col(entity).eqNullSafe(F.lit(e))))
            out = out.unionByName(part.select(*kept, "prediction"))
        return out


def fit_groups(
    df: DataFrame, entity: str, features: list[str], label: str, rounds: int = 100, rate: float = 0.04, depth: int = 3,
    bins: int = BINS, group_rows: int = GROUP_ROWS,
) -> GroupedModel:
    """A boosted regression per entity, null being one too; rows without a label don't train.

    Entities up to `group_rows` rows, however many, are trained in one job.
    Larger ones, of which there are at most rows / group_rows, are fitted one
    by one across the cluster, with medians for missing values.
    """
    labelled = df.filter(F.col(label).isNotNull())
    rows = stable(labelled.select(entity, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, label])]))
    many = small_side(rows.groupBy(entity).count().filter(F.col("count") > group_rows).select(entity, F.lit(True).alias("__large")))
    marked = null_safe_join(rows, many, [entity])
    schema = T.StructType([rows.schema[entity], *_TREES])

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        model = boost(_matrix(group, features), _matrix(group, [label])[:, 0], rounds, rate, depth, bins)
        columns = {f.name: [model["base"] if f.name == "base" else model[f.name].astype({"which": int, "missing_left": bool}.get(f.name, float)).tolist()] for f in _TREES}
        named = {entity: pa.array([key[0].as_py()], group.schema.field(entity).type)}
        kinds = {"base": pa.float64(), "which": pa.list_(pa.int32()), "cut": pa.list_(pa.float64()), "missing_left": pa.list_(pa.bool_()), "leaf": pa.list_(pa.float64())}
        return pa.table(named | {k: pa.array(v, kinds[k]) for k, v in columns.items()})

    small = marked.filter("__large is null").drop("__large")
    models = stable(small.groupBy(entity).applyInArrow(fitted, schema))
    if many.isEmpty():
        return GroupedModel(models, entity, features, depth, {}, group_rows)

    def alone(part: DataFrame, _) -> Model:
        chain = [MedianImputer(features), VectorAssembler(inputCols=features, outputCol="__features")]
        return fit_kept(Pipeline(stages=[*chain, histogram_regressor(label, rounds, rate, depth, features="__features")]), part)

    return GroupedModel(models, entity, features, depth, fit_per_entity(marked.filter("__large").drop("__large"), entity, alone), group_rows)
