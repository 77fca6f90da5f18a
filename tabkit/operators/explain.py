"""Feature importance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.ordered import MAX_ROWS, number_rows
from tabkit.operators.prep import _ColumnModel, feature_names
from tabkit.session import large_side, stable

#: Rounds of the shuffle of positions.
SWAPS = 24
#: Of them in one compiled method.
METHOD = 4
#: Cells up to which rows of a tree model are counted by cell; their pairs are at most the square.
MAX_CELLS = 512


def impurity_importance(model: PipelineModel, sample: DataFrame, vector: str = "features") -> DataFrame:
    """(feature, importance) of a tree model at the end of a pipeline, highest first."""
    names = feature_names(PipelineModel(stages=model.stages[:-1]).transform(sample), vector)
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    spark = sample.sparkSession
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def shuffled_position(position: Column, repeat: Column, n: int, seed: int = 0, rounds: int = SWAPS) -> Column:
    """Where a repeat sends each position of 0 to n - 1: a bijection, computed row by row.

    Swap or not: every round pairs each position with a partner, the same both
    ways, and a coin of the pair says whether the two change places.
    """

    repeat = repeat.cast("long")

    def swap(x: Column, i: Column) -> Column:
        return _placed(x, _partner(x, repeat, i, n, seed), repeat, i, seed)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), position.cast("long"), swap)


def with_shuffled_position(df: DataFrame, position: str, repeat: str, n: int, seed: int = 0, rounds: int = SWAPS) -> DataFrame:
    """`df` with each position replaced by its `shuffled_position`, as projections that are compiled.

    An explode of one value ends every few rounds. It starts a new method in the
    compiled code, as the JVM leaves one of over 8,000 bytes interpreted. And
    it stops the filter for non-null keys that a join on the result asks for:
    pushed below the projections, that would hold all rounds in one expression
    that grows fourfold with each.
    """
    others = [c for c in df.columns if c != position]
    x, partner, times = F.col(position), F.col("_partner"), F.col(repeat).cast("long")
    df = df.select(*others, x.cast("long").alias(position))
    for i in range(1, rounds + 1):
        df = df.select(*others, position, _partner(x, times, F.lit(i), n, seed).alias("_partner"))
        df = df.select(*others, _placed(x, partner, times, F.lit(i), seed).alias(position))
        if i % METHOD == 0 or i == rounds:
            df = df.select(*others, F.explode(F.array(position)).alias(position))
    return df


def _partner(x: Column, repeat: Column, i: Column, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), repeat, i) - x, F.lit(n))


def _placed(x: Column, partner: Column, repeat: Column, i: Column, seed: int) -> Column:
    coin = F.xxhash64(F.lit(seed + 1), repeat, i, F.greatest(x, partner)).bitwiseAND(1)
    return F.when(coin == 1, partner).otherwise(x)


#: Stages that name what they make of a column after it.
_KNOWN_STAGES = (_ColumnModel, VectorAssembler, StringIndexerModel, OneHotEncoderModel)


def unused_features(model: Model, df: DataFrame, features: list[str], vector: str = "features") -> list[str]:
    """Features no tree of the model splits on; none if that can't be told from the model's stages."""
    stages = model.stages if isinstance(model, PipelineModel) else []
    if not stages or not hasattr(stages[-1], "featureImportances") or not all(isinstance(s, _KNOWN_STAGES) for s in _flat(stages[:-1])):
        return []
    weights = stages[-1].featureImportances.toArray()
    names = feature_names(PipelineModel(stages=stages[:-1]).transform(df.limit(0)), stages[-1].getFeaturesCol())
    found = []
    for f in features:
        slots = [w for name, w in zip(names, weights, strict=True) if name == f or name.startswith(f"{f}_")]
        if slots and not any(slots):
            found.append(f)
    return found


@dataclass
class Cells:
    """The boxes into which the splits of a tree model cut its vectors; the model gives one prediction in each.

    A cell is a number whose digits are, slot by slot, how many of the slot's
    thresholds lie below its value.
    """

    model: PipelineModel
    #: Sorted thresholds per slot of the vector, and the feature each slot is made of.
    thresholds: list[list[float]]
    owners: list[str | None]

    def _digits(self) -> list[tuple[int, int, int]]:
        """(slot, place, base) of the slots with thresholds."""
        found, place = [], 1
        for slot, cuts in enumerate(self.thresholds):
            if cuts:
                found.append((slot, place, len(cuts) + 1))
                place *= len(cuts) + 1
        return found

    def of_rows(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, as the stages before the trees leave its columns, with the cell of each row."""
        vector = self.model.stages[-1].getFeaturesCol()
        prepared = PipelineModel(stages=self.model.stages[:-1]).transform(df).withColumn(vector, vector_to_array(vector))
        cell = F.lit(0)
        for slot, place, _ in self._digits():
            for cut in self.thresholds[slot]:  # a value goes left up to the threshold, NaN right
                cell = cell + F.when(F.col(vector)[slot] > cut, place).otherwise(0)
        return prepared.select(*df.columns, cell.alias(name))

    def predicted(self, df: DataFrame, name: str, own: str, lent: str | None = None, feature: str | None = None) -> DataFrame:
        """`df` with the prediction in the cell `own`, but for the feature named in `feature`, which is that of `lent`."""
        last = self.model.stages[-1]
        digits = {slot: (place, base) for slot, place, base in self._digits()}

        def value(slot: int) -> Column:
            if slot not in digits:
                return F.lit(0.0)
            place, base = digits[slot]
            cell = F.col(own) if lent is None else F.when(F.col(feature) == self.owners[slot], F.col(lent)).otherwise(F.col(own))
            # a threshold itself still lies left of it
            return F.array(*[F.lit(v) for v in [*self.thresholds[slot], math.inf]])[F.floor(cell / place).cast("int") % base]

        vectors = df.withColumn(last.getFeaturesCol(), array_to_vector(F.array(*[value(s) for s in range(len(self.thresholds))])))
        return last.transform(vectors).select(*df.columns, F.col("prediction").alias(name))


def cells(model: Model, df: DataFrame, features: list[str], limit: int | None = None) -> Cells | None:
    """The cells of a tree model; none if they may be more than `limit`, or can't be told from the model's stages."""
    limit = MAX_CELLS if limit is None else limit
    stages = model.stages if isinstance(model, PipelineModel) else []
    before = _flat(stages[:-1])
    if not stages or not hasattr(stages[-1], "featureImportances") or not all(isinstance(s, _KNOWN_STAGES) for s in before):
        return None
    if any(s.hasParam("handleInvalid") and s.getOrDefault("handleInvalid") == "skip" for s in before):
        return None  # whether a row counts would depend on the feature shuffled
    names = feature_names(PipelineModel(stages=stages[:-1]).transform(df.limit(0)), stages[-1].getFeaturesCol())
    cuts: list[set[float]] = [set() for _ in names]
    waiting = [t._call_java("rootNode") for t in getattr(stages[-1], "trees", [stages[-1]])]
    while waiting:
        node = waiting.pop()
        if node.subtreeDepth():
            split = node.split()
            if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
                return None
            cuts[split.featureIndex()].add(split.threshold())
            if math.prod(len(c) + 1 for c in cuts) > limit:
                return None
            waiting += [node.leftChild(), node.rightChild()]
    owners = [[f for f in features if name == f or name.startswith(f"{f}_")] for name in names]
    if any(c and len(o) != 1 for c, o in zip(cuts, owners, strict=True)):
        return None
    return Cells(model, [sorted(c) for c in cuts], [o[0] if o else None for o in owners])


def _flat(stages: list) -> list:
    return [s for stage in stages for s in (_flat(stage.stages) if isinstance(stage, PipelineModel) else [stage])]


def permutation_importance(
    model: Model,
    df: DataFrame,
    features: list[str],
    label: str,
    row_id: str,
    repeats: int = 10,
    seed: int = 0,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Mean and population deviation of the loss in R2 when one feature is shuffled.

    Rows are numbered by id once. A repeat's shuffle is a bijection of those
    numbers that every row computes for itself, so nothing is sorted per
    repeat: each row sends its values, one slim struct per repeat, to the row
    it lends them to, and the whole rows move once for all repeats together.
    A repeat's order serves every feature. The change is summed over rows from
    differences of squared errors; features that no tree splits on are not
    shuffled at all and come out at exactly zero. Where the splits of a tree
    model make few cells, a row sends its cell in place of its values, rows are
    counted by their own and their lent cell, and the model sees each such pair
    once, as all its rows have the same prediction.
    """
    idle = unused_features(model, df, features)
    asked = [f for f in features if f not in idle]
    spark = df.sparkSession
    zeros = spark.createDataFrame([(f, 0.0, 0.0) for f in idle], "feature string, mean double, std double")
    if not asked:
        return zeros
    rows = _Numbered(df, features, label, row_id, max_rows)
    if not rows.n:
        nothing = spark.createDataFrame([(f,) for f in asked], "feature string")
        return nothing.select("feature", *[F.lit(None).cast("double").alias(c) for c in ("mean", "std")]).unionByName(zeros)
    found = rows.drops(model, features, asked, 0, repeats - 1, seed).groupBy(F.col("_feature").alias("feature")).agg(
        F.avg("_drop").alias("mean"), F.stddev_pop("_drop").alias("std")
    )
    return found.unionByName(zeros) if idle else found


class _Numbered:
    """Rows numbered by id and written out, with their number and the sum of squares of the label."""

    def __init__(self, df: DataFrame, features: list[str], label: str, row_id: str, max_rows: int | None = MAX_ROWS):
        # read twice below, so numbered once and written out
        own = number_rows(stable(df.select(row_id, label, *features)), [], [row_id], max_rows=max_rows)
        # and spread again, as numbering may have put a small table into one task
        spread = df.sparkSession.sparkContext.defaultParallelism
        self.rows = stable(own.df.repartition(spread, own.pos)) if not own.split else own.df
        self.pos, self.label, self.target = own.pos, label, F.col(label).cast("double")
        self.n, self.spread = self.rows.agg(F.count(F.lit(1)), F.var_pop(self.target) * F.count(self.target)).first()

    def drops(self, model: Model, features: list[str], asked: list[str], first: int, last: int, seed: int) -> DataFrame:
        """(_feature, _repeat, _drop) of the asked features in the repeats `first` to `last`."""
        if boxes := cells(model, self.rows, features):
            return self._drops_by_cell(boxes, asked, first, last, seed)
        # a stage may leave a column changed, and the values go through the stages once more
        own = self.rows.select(self.pos, self.label, *features, F.struct(self.label, *features).alias("_own"))
        base = model.transform(own).select(self.pos, "_own", F.col("prediction").alias("_base"))
        paired = base.join(self._lent(self.rows, F.struct(*asked), first, last, seed), self.pos)
        shuffled = paired.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in asked]))).select(
            "_feature", "_repeat", F.col("_own")[self.label].alias(self.label), "_base",
            *[(F.when(F.col("_feature") == f, F.col("_lent")[f]).otherwise(x) if f in asked else x).alias(f) for f, x in ((f, F.col("_own")[f]) for f in features)],
        )
        wrong, right = self.target - F.col("prediction"), self.target - F.col("_base")
        return model.transform(shuffled).groupBy("_feature", "_repeat").agg(
            F.try_divide(F.sum(wrong * wrong - right * right), F.lit(self.spread)).alias("_drop")
        )

    def _lent(self, rows: DataFrame, values: Column, first: int, last: int, seed: int) -> DataFrame:
        """(_lent, _repeat, position): the values of each row where each repeat sends them, to be joined by position."""
        lent = rows.select(self.pos, values.alias("_lent")).withColumn("_repeat", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return large_side(with_shuffled_position(lent, self.pos, "_repeat", self.n, seed))

    def _drops_by_cell(self, boxes: Cells, asked: list[str], first: int, last: int, seed: int) -> DataFrame:
        rows = boxes.of_rows(self.rows, "_cell").select(self.pos, self.target.alias("_y"), "_cell")
        paired = rows.join(self._lent(rows, F.col("_cell"), first, last, seed), self.pos)
        pairs = paired.groupBy("_repeat", "_cell", "_lent").agg(F.count("_y").alias("_n"), F.sum("_y").alias("_sum"))
        pairs = boxes.predicted(pairs, "_base", "_cell")
        pairs = pairs.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in asked])))
        pairs = boxes.predicted(pairs, "_changed", "_cell", "_lent", "_feature")
        # over the rows of a pair, (y - changed)^2 - (y - base)^2 in sum
        more = (F.col("_changed") - F.col("_base")) * (F.col("_n") * (F.col("_changed") + F.col("_base")) - 2 * F.col("_sum"))
        return pairs.groupBy("_feature", "_repeat").agg(F.try_divide(F.sum(more), F.lit(self.spread)).alias("_drop"))

    def without_effect(self, model: Model, features: list[str], asked: list[str], repeats: int, seed: int) -> list[str]:
        """The asked features whose every repeat leaves the loss as it was.

        One repeat that changes the loss settles a feature, so all are asked
        once, and those it left unchanged in all other repeats.
        """
        for first, last in ((0, 0), (1, repeats - 1)):
            if asked and first <= last:
                drops: dict[str, list] = {f: [] for f in asked}
                for r in self.drops(model, features, asked, first, last, seed).collect():
                    drops[r["_feature"]].append(r["_drop"])
                asked = [f for f in asked if drops[f] and all(d == 0 for d in drops[f])]
        return asked


def eliminate_features(
    df: DataFrame,
    features: list[str],
    label: str,
    row_id: str,
    fit: Callable[[DataFrame, list[str]], Model],
    repeats: int = 10,
    seed: int = 0,
) -> tuple[Model, list[str], list[list[str]]]:
    """Refit without the features of zero importance until none is left.

    Returns the last model, its features, and the features dropped in each round.
    The importance is zero if no repeat of `permutation_importance` changes the
    loss; the rows are numbered once for all rounds.
    """
    rounds: list[list[str]] = []
    features = sorted(features)
    df = stable(df)
    rows = None
    while True:
        model = fit(df, features)
        useless = unused_features(model, df, features)
        asked = [f for f in features if f not in useless]
        if asked:
            rows = rows or _Numbered(df, features, label, row_id)
            useless = sorted([*useless, *rows.without_effect(model, features, asked, repeats, seed)])
        if not useless or len(useless) == len(features):
            return model, features, rounds
        rounds.append(useless)
        features = [f for f in features if f not in useless]
