"""Exact evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators.ordered import MAX_ROWS, neighbourhood, number_rows, running_sum


def stack_labels(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """(label, truth, score) rows from one (truth, score) column pair per label."""
    parts = [
        F.struct(F.lit(name).alias("label"), F.col(y).cast("int").alias("truth"), F.col(s).cast("double").alias("score"))
        for name, (y, s) in labels.items()
    ]
    return df.select(F.inline(F.array(*parts)))


def _by_score(df: DataFrame, keys: list[str], truth: str, score: str, max_rows: int | None) -> DataFrame:
    """Positives and negatives per distinct score, their running counts from the top score down, and totals.

    Only rows with truth 0 or 1 and a score count: a null score ranks nowhere.
    """
    per_score = df.filter(F.col(truth).isin(0, 1) & F.col(score).isNotNull()).groupBy(*keys, (-F.col(score)).alias("_down")).agg(
        F.count(F.when(F.col(truth) == 1, 1)).alias("_pos"), F.count(F.when(F.col(truth) == 0, 1)).alias("_neg")
    )
    sums = {"_tp": F.col("_pos"), "_fp": F.col("_neg")}
    totals = {"_p": F.sum("_pos"), "_n": F.sum("_neg")}
    return running_sum(per_score, keys, ["_down"], sums, max_rows, totals, derived=True)


def roc_curve(
    df: DataFrame, keys: list[str], truth: str = "truth", score: str = "score",
    drop_collinear: bool = False, max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, plus the start (0, 0) at an infinite threshold.

    `drop_collinear` leaves out the inner points of straight stretches.
    """
    ranked = _by_score(df, keys, truth, score, max_rows)
    top = F.col("_tp") + F.col("_fp") == F.col("_pos") + F.col("_neg")
    zero = F.lit(0).cast("long")
    point = F.struct("_down", "_tp", "_fp")
    # the top score's row brings the start along
    start = F.struct(F.lit(float("-inf")).alias("_down"), zero.alias("_tp"), zero.alias("_fp"))
    points = ranked.select(
        *keys, "_p", "_n", F.inline(F.when(top, F.array(start, point)).otherwise(F.array(point)))
    )
    if drop_collinear:
        rows = number_rows(points, keys, ["_down"], max_rows=max_rows, derived=True)

        def bends(w) -> dict[str, Column]:
            def bend(c):
                return F.lag(c).over(w) + F.lead(c).over(w) - 2 * F.col(c)

            # no neighbour on one side: an end point, which stays
            return {"_keep": F.coalesce((bend("_tp") != 0) | (bend("_fp") != 0), F.lit(True))}

        points = neighbourhood(rows, 1, 1, bends).df.filter("_keep")
    return points.select(
        *keys,
        F.try_divide("_fp", "_n").alias("fpr"),
        F.try_divide("_tp", "_p").alias("tpr"),
        (-F.col("_down")).alias("threshold"),
    )


def roc_auc(
    df: DataFrame, keys: list[str], truth: str = "truth", score: str = "score", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Exact area under the ROC curve per key; tied scores count half."""
    ranked = _by_score(df, keys, truth, score, max_rows)
    area = F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(area, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def macro_auc(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("auc").alias("auc"))


def multilabel_scores(df: DataFrame, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """Subset accuracy, micro precision and micro recall from (truth, predicted) 0/1 column pairs.

    A null prediction is a wrong one: it matches no truth, and misses a truth of 1.
    Rows in which a truth is null are left out.
    """
    pairs = list(labels.values())
    same = F.lit(True)
    tp = fp = fn = F.lit(0)
    df = df.dropna(subset=[y for y, _ in pairs])
    for y, p in pairs:
        y, p = F.col(y), F.coalesce(F.col(p).cast("double"), F.lit(-1.0))
        same = same & (y == p)
        tp = tp + F.when((y == 1) & (p == 1), 1).otherwise(0)
        fp = fp + F.when((y == 0) & (p == 1), 1).otherwise(0)
        fn = fn + F.when((y == 1) & (p != 1), 1).otherwise(0)
    return df.agg(
        F.avg(same.cast("double")).alias("accuracy"),
        F.try_divide(F.sum(tp), F.sum(tp) + F.sum(fp)).alias("precision_micro"),
        F.try_divide(F.sum(tp), F.sum(tp) + F.sum(fn)).alias("recall_micro"),
    )


def f1_micro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Micro F1 of a single-label problem, which is its accuracy; a null prediction is a wrong one, a null truth no row."""
    right = F.coalesce(F.col(truth) == F.col(predicted), F.lit(False))
    return df.filter(F.col(truth).isNotNull()).agg(F.avg(right.cast("double")).alias("f1_micro"))


def rmse_r2(df: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """Root mean squared error and R² over the rows that have both values."""
    error = F.col(truth).cast("double") - F.col(predicted).cast("double")
    sse = F.sum(error * error)
    known = F.when(F.col(predicted).isNotNull(), F.col(truth).cast("double"))
    spread = F.var_pop(known) * F.count(known)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.try_divide(sse, spread)).alias("r2")
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class; 0 where undefined."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("given")),
            )
        ),
        F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    # a hit appears on both sides, so it is halved
    sums = sides.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("given").alias("_given"), (F.sum("hit") / 2).alias("_hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("_hit"), F.col("_given")), zero)
    recall = F.coalesce(F.try_divide(F.col("_hit"), F.col("support")), zero)
    return sums.withColumns({"precision": precision, "recall": recall}).select(
        "class", "support", "precision", "recall",
        F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero
        ).alias("f1"),
    )


def prediction_table(
    df: DataFrame, keys: list[str], date: str, predicted: str, actual: str
) -> DataFrame:
    """Prediction next to the actual value per entity and date, with the absolute error."""
    error = F.abs(F.col(predicted) - F.col(actual))
    return df.select(*keys, date, predicted, actual, error.alias("abs_error")).orderBy(date, *keys)


class MacroAucEvaluator(Evaluator):
    """Mean exact ROC AUC over labels, for `CrossValidator`; also keeps the other multi-label scores.

    Each label's pipeline leaves `<label>_probability` and `<label>_prediction`.
    """

    def __init__(self, labels: list[str]):
        super().__init__()
        self.labels = labels

    def scores(self, scored: DataFrame) -> dict[str, float]:
        from tabkit.operators.score import positive_probability

        wide = scored.select(
            *self.labels,
            *[positive_probability(f"{n}_probability").alias(f"_p_{n}") for n in self.labels],
            *[F.col(f"{n}_prediction").cast("int").alias(f"_c_{n}") for n in self.labels],
        )
        long = stack_labels(wide, {n: (n, f"_p_{n}") for n in self.labels})
        auc = macro_auc(roc_auc(long, ["label"])).first()["auc"]
        rest = multilabel_scores(wide, {n: (n, f"_c_{n}") for n in self.labels}).first().asDict()
        return {"roc_auc": auc, **rest}

    def _evaluate(self, dataset: DataFrame) -> float:
        return self.scores(dataset)["roc_auc"]

    def isLargerBetter(self) -> bool:
        return True
