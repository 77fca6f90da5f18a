"""Registered queries: evaluation metrics on given labels and simple scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.catalog.common import WEEKLY_SQL, round_columns, table, weekly_orders
from tabkit.operators import evaluate as E
from tabkit.operators import joins as J
from tabkit.session import small_side


def _scored_orders(spark, d):
    """Is an order finished, and its price as a score; the coarse score has many ties."""
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("truth"),
        price.alias("score"),
        F.floor(price / 1000).cast("double").alias("coarse"),
    )


def _scored_documents(spark, d):
    """Two 0/1 labels with length-based scores and predictions."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    joined = J.natural_join(docs, table(spark, d, "labels"))
    n = F.col("n_chars").cast("double")
    return joined.withColumns(
        {
            "quality_score": n,
            "toxic_score": -n,
            "quality_hat": (n > 1000).cast("int"),
            "toxic_hat": (n < 500).cast("int"),
        }
    )


def roc_curve(spark, d):
    return round_columns(E.roc_curve(_scored_orders(spark, d), [], score="coarse"), ["fpr", "tpr"], 8)


def roc_corners(spark, d):
    long = E.stack_labels(
        _scored_documents(spark, d), {"quality": ("quality", "quality_score"), "toxic": ("toxic", "toxic_score")}
    )
    return round_columns(E.roc_curve(long, ["label"], drop_collinear=True), ["fpr", "tpr"], 8)


def roc_auc(spark, d):
    return round_columns(E.roc_auc(_scored_orders(spark, d), []), ["auc"], 8)


def roc_auc_labels(spark, d):
    long = E.stack_labels(
        _scored_documents(spark, d), {"quality": ("quality", "quality_score"), "toxic": ("toxic", "toxic_score")}
    )
    per_label = small_side(E.roc_auc(long, ["label"]))  # one row per label, read twice
    macro = E.macro_auc(per_label).select(F.lit("macro").alias("label"), "auc")
    return round_columns(per_label.unionByName(macro), ["auc"], 8)


def multilabel_scores(spark, d):
    pairs = {"quality": ("quality", "quality_hat"), "toxic": ("toxic", "toxic_hat")}
    out = E.multilabel_scores(_scored_documents(spark, d), pairs)
    return round_columns(out, ["accuracy", "precision_micro", "recall_micro"], 8)


def _graded(spark, d):
    """Order status against a guess from the price."""
    price = F.col("o_totalprice")
    guess = F.when(price < 150_000, "F").when(price < 300_000, "O").otherwise("P")
    return table(spark, d, "orders").select("o_orderstatus", guess.alias("guess"))


def f1_micro(spark, d):
    return round_columns(E.f1_micro(_graded(spark, d), "o_orderstatus", "guess"), ["f1_micro"], 8)


def confusion(spark, d):
    return E.confusion(_graded(spark, d), "o_orderstatus", "guess")


def class_report(spark, d):
    out = E.class_report(_graded(spark, d), "o_orderstatus", "guess")
    return round_columns(out, ["precision", "recall", "f1"], 8)


def _last_year(spark, d):
    lagged = J.date_lags(weekly_orders(spark, d), "week", "total", {"predicted": 364}, ["priority"])
    return lagged.filter(F.col("predicted").isNotNull())


def rmse_r2(spark, d):
    out = E.rmse_r2(_last_year(spark, d), "total", "predicted", ["priority"])
    return round_columns(out, ["rmse", "r2"])


def pred_vs_actual(spark, d):
    out = E.prediction_table(_last_year(spark, d), ["priority"], "week", "predicted", "total")
    return round_columns(out, ["abs_error"], 2)


QUERIES = {
    f.__name__: f
    for f in (
        roc_curve, roc_corners, roc_auc, roc_auc_labels, multilabel_scores, f1_micro, confusion, class_report, rmse_r2,
        pred_vs_actual,
    )
}

DOCS_SQL = """s AS (SELECT quality, toxic, n_chars::DOUBLE AS qs, -n_chars::DOUBLE AS ts,
  CAST(n_chars > 1000 AS INTEGER) AS qh, CAST(n_chars < 500 AS INTEGER) AS th
  FROM documents JOIN labels USING (doc_id))"""
LONG_SQL = f"""{DOCS_SQL}, l AS (SELECT 'quality' AS label, quality AS y, qs AS score FROM s
  UNION ALL SELECT 'toxic', toxic, ts FROM s)"""
GRADED_SQL = """g AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice < 150000 THEN 'F'
  WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS p FROM orders)"""
LAST_YEAR_SQL = f"""{WEEKLY_SQL}, ly AS (SELECT w.priority, w.week, w.total, a.total AS predicted
  FROM weekly w JOIN weekly a ON a.priority = w.priority AND a.week = w.week - 364)"""
# rank form: the sum of tie-averaged ranks of the positives
AUC_SQL = """r AS (SELECT label, y, rank() OVER w + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE AS rk
    FROM l WINDOW w AS (PARTITION BY label ORDER BY score)),
  auc AS (SELECT label, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
    / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1)"""

ORACLE = {
    "roc_curve": """WITH s AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, floor(o_totalprice / 1000) AS score FROM orders),
      c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS f FROM s GROUP BY 1),
      r AS (SELECT sum(f) OVER (ORDER BY score DESC) AS fp, sum(p) OVER (ORDER BY score DESC) AS tp, score AS threshold FROM c)
      SELECT round(fp / (SELECT sum(f) FROM c), 8) AS fpr, round(tp / (SELECT sum(p) FROM c), 8) AS tpr, threshold FROM r
      UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, 'inf'::DOUBLE""",
    "roc_corners": f"""WITH {LONG_SQL},
      c AS (SELECT label, score, sum(y) AS p, count(*) - sum(y) AS f FROM l GROUP BY 1, 2),
      r AS (SELECT label, score, sum(f) OVER w AS fp, sum(p) OVER w AS tp FROM c
        WINDOW w AS (PARTITION BY label ORDER BY score DESC) UNION ALL SELECT DISTINCT label, 'inf'::DOUBLE, 0, 0 FROM c),
      b AS (SELECT *, lag(fp) OVER v AS f0, lead(fp) OVER v AS f1, lag(tp) OVER v AS t0, lead(tp) OVER v AS t1 FROM r
        WINDOW v AS (PARTITION BY label ORDER BY score DESC)),
      t AS (SELECT label, sum(f) AS nf, sum(p) AS np FROM c GROUP BY 1)
      SELECT label, round(fp / nf, 8) AS fpr, round(tp / np, 8) AS tpr, score AS threshold FROM b JOIN t USING (label)
      WHERE f0 IS NULL OR f1 IS NULL OR f0 + f1 <> 2 * fp OR t0 + t1 <> 2 * tp""",
    "roc_auc": f"""WITH l AS (SELECT 'x' AS label, CAST(o_orderstatus = 'F' AS INTEGER) AS y, o_totalprice AS score FROM orders),
      {AUC_SQL} SELECT round(auc, 8) AS auc FROM auc""",
    "roc_auc_labels": f"""WITH {LONG_SQL}, {AUC_SQL} SELECT label, round(auc, 8) AS auc FROM auc
      UNION ALL SELECT 'macro', round(avg(auc), 8) FROM auc""",
    "multilabel_scores": f"""WITH {DOCS_SQL}, c AS (SELECT avg(CAST(quality = qh AND toxic = th AS DOUBLE)) AS acc,
        sum(quality * qh + toxic * th) AS tp, sum(qh + th) AS given, sum(quality + toxic) AS actual FROM s)
      SELECT round(acc, 8) AS accuracy, round(tp / given, 8) AS precision_micro, round(tp / actual, 8) AS recall_micro FROM c""",
    "f1_micro": f"WITH {GRADED_SQL} SELECT round(avg(CAST(y = p AS DOUBLE)), 8) AS f1_micro FROM g",
    "confusion": f"WITH {GRADED_SQL} SELECT y AS truth, p AS predicted, count(*) AS n FROM g GROUP BY 1, 2",
    "class_report": f"""WITH {GRADED_SQL}, k AS (SELECT DISTINCT y AS class FROM g),
      c AS (SELECT class, count(*) FILTER (y = class) AS support, count(*) FILTER (p = class) AS given,
        count(*) FILTER (y = class AND p = class) AS hit FROM g, k GROUP BY 1)
      SELECT class, support, round(hit / given, 8) AS precision, round(hit / support, 8) AS recall,
        round(2 * hit / (given + support), 8) AS f1 FROM c""",
    "rmse_r2": f"""WITH {LAST_YEAR_SQL} SELECT priority, round(sqrt(avg((total - predicted) ** 2)), 4) AS rmse,
      round(1 - sum((total - predicted) ** 2) / (var_pop(total) * count(*)), 4) AS r2 FROM ly GROUP BY 1""",
    "pred_vs_actual": f"""WITH {LAST_YEAR_SQL} SELECT priority, week, predicted, total,
      round(abs(predicted - total), 2) AS abs_error FROM ly""",
}
