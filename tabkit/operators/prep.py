"""Preprocessing stages that tolerate nulls, for use in `pyspark.ml.Pipeline`.

Each estimator learns a handful of numbers per column with SQL aggregates over
the non-null values and keeps them as a parameter, so fitted stages save and
load like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import box_cox
from tabkit.operators.impute import column_medians, column_modes
from tabkit.operators.profile import long_form
from tabkit.operators.stats import as_double, box_cox_exponent, quantiles


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "columns to work on", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "appended to the output names", TypeConverters.toString)

    def _names(self):
        columns, suffix = self.getOrDefault("columns"), self.getOrDefault("suffix")
        return [(c, c + suffix) for c in columns]

    def outputs(self) -> list[str]:
        return [out for _, out in self._names()]


class _ColumnEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    model_class: type

    def __init__(self, columns: list[str] | None = None, suffix: str = ""):
        super().__init__()
        self._setDefault(suffix="")
        self._set(columns=columns or [], suffix=suffix)

    def _learn(self, df: DataFrame) -> dict:
        raise NotImplementedError

    def _fit(self, df: DataFrame):
        return self._copyValues(self.model_class(state=self._learn(df)))


class _ColumnModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "what was learnt, by column", TypeConverters.identity)

    def __init__(self, state: dict | None = None):
        super().__init__()
        self._setDefault(suffix="", columns=[])
        self._set(state=state or {})

    def _expression(self, column: str, learnt):
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.getOrDefault("state")
        return df.withColumns({out: self._expression(c, state.get(c)) for c, out in self._names()})


class FrequentImputerModel(_ColumnModel):
    def _expression(self, column, learnt):
        return F.coalesce(F.col(column), F.lit(learnt))


class FrequentImputer(_ColumnEstimator):
    """Nulls become the most frequent value, the smallest on ties; works on text."""

    model_class = FrequentImputerModel

    def _learn(self, df):
        return column_modes(df, self.getOrDefault("columns"))


class MedianImputerModel(_ColumnModel):
    def _expression(self, column, learnt):
        return F.coalesce(F.col(column).cast("double"), F.lit(0.0 if learnt is None else learnt))


class MedianImputer(_ColumnEstimator):
    """Nulls become the exact median (mean of the two middle values), or 0 if no value is known."""

    model_class = MedianImputerModel

    def _learn(self, df):
        return column_medians(df, self.getOrDefault("columns"))


class NullFlagsModel(_ColumnModel):
    def _expression(self, column, learnt):
        return F.col(column).isNull().cast("double")


class NullFlags(_ColumnEstimator):
    """1 where the column is null, for models that cannot take nulls themselves."""

    model_class = NullFlagsModel

    def __init__(self, columns=None, suffix="_was_null"):
        super().__init__(columns, suffix)

    def _learn(self, df):
        return {}


class StandardScaleModel(_ColumnModel):
    def _expression(self, column, learnt):
        mean, scale = learnt
        return (F.col(column) - F.lit(mean)) / F.lit(scale)


class StandardScale(_ColumnEstimator):
    """(x - mean) / population standard deviation; a constant column keeps scale 1."""

    model_class = StandardScaleModel
    withMean = Param(Params._dummy(), "withMean", "subtract the mean", TypeConverters.toBoolean)

    def __init__(self, columns=None, suffix="", with_mean: bool = True):
        super().__init__(columns, suffix)
        self._set(withMean=with_mean)

    def _learn(self, df):
        columns = self.getOrDefault("columns")
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        centre = self.getOrDefault("withMean")
        return {
            c: [(row[f"m{i}"] or 0.0) if centre else 0.0, row[f"s{i}"] or 1.0] for i, c in enumerate(columns)
        }


class MinMaxScaleModel(_ColumnModel):
    def _expression(self, column, learnt):
        low, span = learnt
        return (F.col(column) - F.lit(low)) / F.lit(span)


class MinMaxScale(_ColumnEstimator):
    """To [0, 1] over the non-null values; a constant column becomes 0."""

    model_class = MinMaxScaleModel

    def _learn(self, df):
        columns = self.getOrDefault("columns")
        row = df.agg(
            *[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.max(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        out = {}
        for i, c in enumerate(columns):
            low, high = row[f"a{i}"], row[f"b{i}"]
            out[c] = [0.0, 1.0] if low is None else [low, (high - low) or 1.0]
        return out


class RobustScaleModel(_ColumnModel):
    def _expression(self, column, learnt):
        centre, span = learnt
        return (F.col(column) - F.lit(centre)) / F.lit(span)


class RobustScale(_ColumnEstimator):
    """(x - median) / interquartile range, both exact; a range of zero keeps scale 1."""

    model_class = RobustScaleModel

    def _learn(self, df):
        columns = self.getOrDefault("columns")
        long = long_form(as_double(df, columns), columns, [])
        found = quantiles(long, ["feature"], "value", {"q1": 0.25, "mid": 0.5, "q3": 0.75}).collect()
        learnt = {r["feature"]: [r["mid"], (r["q3"] - r["q1"]) or 1.0] for r in found}
        return {c: learnt.get(c, [0.0, 1.0]) for c in columns}


class BoxCoxModel(_ColumnModel):
    def _expression(self, column, learnt):
        return box_cox(F.col(column).cast("double"), learnt)


class BoxCox(_ColumnEstimator):
    """Power transform with the exponent of greatest likelihood; for positive values, others become null."""

    model_class = BoxCoxModel

    def _learn(self, df):
        return {c: box_cox_exponent(df, c) for c in self.getOrDefault("columns")}


class BinaryOneHotModel(_ColumnModel):
    ignoreUnknown = Param(Params._dummy(), "ignoreUnknown", "unknown becomes 0", TypeConverters.toBoolean)

    def _expression(self, column, learnt):
        first, second = learnt
        c = F.col(column)
        other = F.lit(0.0)
        if not self.getOrDefault("ignoreUnknown"):
            message = F.concat(F.lit(f"unknown category in {column}: "), c.cast("string"))
            other = F.when(c == F.lit(first), 0.0).otherwise(F.raise_error(message).cast("double"))
        return F.when(c == F.lit(second), 1.0).otherwise(other)


class BinaryOneHot(_ColumnEstimator):
    """One 0/1 column for a column of two categories; 1 is the later in sort order."""

    model_class = BinaryOneHotModel
    ignoreUnknown = Param(Params._dummy(), "ignoreUnknown", "unknown becomes 0", TypeConverters.toBoolean)

    def __init__(self, columns=None, suffix="", ignore_unknown: bool = False):
        super().__init__(columns, suffix)
        self._set(ignoreUnknown=ignore_unknown)

    def _learn(self, df):
        columns = self.getOrDefault("columns")
        ends = df.agg(
            *[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)],
            *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)],
        ).first()
        found = {c: [ends[f"a{i}"], ends[f"b{i}"]] for i, c in enumerate(columns)}
        between = df.agg(
            *[F.count(F.when(~F.col(c).isin(*found[c]), 1)).alias(f"n{i}") for i, c in enumerate(columns)]
        ).first()
        wrong = [c for i, c in enumerate(columns) if between[f"n{i}"] or found[c][0] == found[c][1]]
        if wrong:
            raise ValueError(f"not two categories: {wrong}")
        return found


def one_hot_stages(columns: list[str], suffix: str = "_onehot") -> list:
    """One-hot stages in which an unknown or null category gives all zeros."""
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(
            inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=[c + suffix for c in columns], dropLast=True),
    ]


@dataclass
class Roles:
    """Which columns take which preprocessing chain."""

    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)


def column_bundle(
    roles: Roles, numeric: list | None = None, ignore_unknown: bool = False, out: str = "features"
) -> Pipeline:
    """Preprocess each role's columns and assemble them, in role order, into one vector.

    `numeric` lists stage factories taking the column names; the default scales
    first and then fills with the median of the scaled column.
    """
    stages, assembled = [], []
    if roles.numeric:
        chain = numeric if numeric is not None else [StandardScale, MedianImputer]
        stages += [make(roles.numeric) for make in chain]
        assembled += roles.numeric
    if roles.categorical:
        stages += [FrequentImputer(roles.categorical), *one_hot_stages(roles.categorical)]
        assembled += [f"{c}_onehot" for c in roles.categorical]
    if roles.binary:
        stages += [FrequentImputer(roles.binary), BinaryOneHot(roles.binary, "_flag", ignore_unknown)]
        assembled += [f"{c}_flag" for c in roles.binary]
    assembled += roles.passthrough
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=assembled, outputCol=out)])


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of a vector column's slots, as its stages recorded them."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"].values()
    slots = sorted((a["idx"], a["name"]) for group in groups for a in group)
    # the encoder's mark stands between column and category; a mark inside a column's own name stays
    return ["".join(name.rsplit("_onehot", 1)) if "_onehot_" in name else name for _, name in slots]
