"""Registered queries: moments, skew, correlation, quantiles, missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabkit.catalog.common import READINGS_SQL, readings, round_columns, table
from tabkit.functions import scalars as S
from tabkit.operators import columns as C
from tabkit.operators import impute as M
from tabkit.operators import stats as A

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def mean_var(spark, d):
    out = A.mean_var(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return round_columns(out, ["mean", "var"])


def min_max(spark, d):
    return A.min_max(table(spark, d, "lineitem"), MEASURES)


def skew_label(spark, d):
    return round_columns(A.skew_report(table(spark, d, "lineitem"), MEASURES), ["skewness"])


def transform_skew(spark, d):
    return round_columns(A.transform_skews(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"]), ["skewness"])


def best_transform(spark, d):
    skews = A.transform_skews(table(spark, d, "events"), ["value"])
    return round_columns(A.best_transform(skews), ["abs_skewness"])


def guarded_transforms(spark, d):
    v = F.col("value")
    out = table(spark, d, "events").select(
        "event_id", S.sqrt_abs(v).alias("root"), S.reciprocal(v).alias("inverse"), S.log_positive(v).alias("log")
    )
    return round_columns(out, ["root", "inverse", "log"], 6)


def corr_long(spark, d):
    return round_columns(A.correlations(table(spark, d, "lineitem"), MEASURES), ["corr"], 6)


def corr_high(spark, d):
    lines = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pairs = A.correlations(lines, [*MEASURES, "net"], absolute=True)
    return round_columns(A.high_correlations(pairs, 0.95), ["corr"], 6)


def corr_target(spark, d):
    out = A.target_correlations(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return round_columns(out, ["corr"], 6)


def phi_coefficient(spark, d):
    return round_columns(A.phi(table(spark, d, "labels"), "quality", "toxic"), ["phi"], 6)


def exact_quantiles(spark, d):
    asked = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    return round_columns(A.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", asked), list(asked))


def _by_year(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"), "o_totalprice"
    )


def box_stats(spark, d):
    out = A.box_stats(_by_year(spark, d), ["o_orderstatus", "year"], "o_totalprice")
    return round_columns(out, ["q1", "median", "q3", "whisker_low", "whisker_high"])


def box_outliers(spark, d):
    return A.box_outliers(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


def qq_points(spark, d):
    points = A.probability_points(table(spark, d, "customer"), ["c_acctbal"], "c_custkey")
    return round_columns(points, ["theoretical"], 6)


def qq_fit(spark, d):
    points = A.probability_points(table(spark, d, "orders"), ["o_totalprice"], "o_orderkey")
    return round_columns(A.probability_fit(points), ["slope", "intercept", "r"], 4)


def monotonic(spark, d):
    return A.is_monotonic(table(spark, d, "events"), "ts", ["event_id"], ["event_type"])


def redundant_measures(spark, d):
    lines = table(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pairs = A.high_correlations(A.correlations(lines, [*MEASURES, "net"]), 0.95).select("feature_a", "feature_b")
    # column pairs, so the list is bounded by the table's width
    gone = A.redundant_columns([tuple(r) for r in pairs.collect()])
    return A.min_max(C.drop_columns(lines, gone), [c for c in [*MEASURES, "net"] if c not in gone])


def rare_flags(spark, d):
    flags = table(spark, d, "part").select(
        "p_partkey",
        S.indicator(F.col("p_brand"), "Brand#2").alias("is_brand_2"),
        S.indicator(F.col("p_type"), "PROMO").alias("is_promo"),
    )
    return C.drop_columns(flags, A.rare_binary_columns(flags, ["is_brand_2", "is_promo"], 0.1))


def fill_const_mean(spark, d):
    base = readings(spark, d).select("event_id", "event_type", "kind", "reading")
    base = base.withColumns({"by_mean": F.col("reading"), "by_type_mean": F.col("reading")})
    filled = M.fill_mean(base, ["by_mean"])
    filled = M.fill_mean(filled, ["by_type_mean"], ["event_type"])
    filled = M.fill_constant(filled, {"kind": "unknown", "reading": 0.0})
    return round_columns(filled, ["by_mean", "by_type_mean"])


def impute_median_mode(spark, d):
    base = readings(spark, d).select("event_id", "kind", "reading")
    return round_columns(M.fill_mode(M.fill_median(base, ["reading"]), ["kind"]), ["reading"])


def sentinel_check(spark, d):
    return M.column_minima(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


def sentinel_repair(spark, d):
    size = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_size").alias("size_or_median"))
    out = M.sentinel_to_null(size, ["p_size"], 50)
    median = M.column_medians(out, ["p_size"])["p_size"]
    whole = F.lit(median).cast("int")
    return out.withColumn("size_or_median", S.replace_sentinel(F.col("size_or_median"), 50, whole))


QUERIES = {
    f.__name__: f
    for f in (
        mean_var, min_max, skew_label, transform_skew, best_transform, guarded_transforms, corr_long, corr_high,
        corr_target, phi_coefficient, exact_quantiles, box_stats, box_outliers, qq_points, qq_fit, monotonic,
        redundant_measures, rare_flags, fill_const_mean, impute_median_mode, sentinel_check, sentinel_repair,
    )
}


def _skew_sql(x: str, src: str) -> str:
    return f"(SELECT skewness(x) FROM (SELECT {x} AS x FROM {src}))"


def _corr_sql(src: str, columns: list[str], absolute: bool) -> str:
    value = "abs(corr({a}, {b}))" if absolute else "corr({a}, {b})"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({value.format(a=a, b=b)}, 6) AS corr FROM {src}"
        for a in columns
        for b in columns
    )


CANDIDATES_SQL = {
    "raw": "{c}::DOUBLE",
    "log": "CASE WHEN {c} > 0 THEN ln({c}) END",
    "reciprocal": "CASE WHEN {c} <> 0 THEN 1.0::DOUBLE / {c} END",
    "sqroot": "CASE WHEN {c} >= 0 THEN sqrt({c}) END",
    "exponential": "CASE WHEN {c} >= 0 THEN pow({c}, 1.0::DOUBLE / 1.2::DOUBLE) END",
}


def _transform_sql(src: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{n}' AS transform, {_skew_sql(x.format(c=c), src)} AS skewness"
        for c in columns
        for n, x in CANDIDATES_SQL.items()
    )


NET_SQL = "(SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"
FENCES_SQL = """q AS (SELECT {keys}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
  quantile_cont({v}, 0.75) AS q3 FROM {src} GROUP BY ALL)"""


def _horner(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _points_sql(src: str, value: str, row_id: str) -> str:
    """Normal-probability points, with the quantile function written out in SQL."""
    ratio = {
        "centre": (_horner("cr", S.AS241_CENTRE_NUM), _horner("cr", S.AS241_CENTRE_DEN)),
        "middle": (_horner("(t - 1.6)", S.AS241_MIDDLE_NUM), _horner("(t - 1.6)", S.AS241_MIDDLE_DEN)),
        "outer": (_horner("(t - 5.0)", S.AS241_TAIL_NUM), _horner("(t - 5.0)", S.AS241_TAIL_DEN)),
    }
    r = {k: f"({a} / {b})" for k, (a, b) in ratio.items()}
    return f"""r AS (SELECT {row_id}, {value}::DOUBLE AS ordered,
        row_number() OVER (ORDER BY {value}, {row_id}) AS i, count(*) OVER ()::DOUBLE AS n FROM {src}),
      f AS (SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1 / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n)
        ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM r),
      g AS (SELECT *, p - 0.5 AS q, 0.180625::DOUBLE - (p - 0.5) * (p - 0.5) AS cr,
        sqrt(-ln(least(p, 1 - p))) AS t FROM f),
      points AS (SELECT '{value}' AS feature, {row_id}, ordered, CASE WHEN abs(q) <= 0.425 THEN q * {r['centre']}
        ELSE sign(q) * CASE WHEN t <= 5.0 THEN {r['middle']} ELSE {r['outer']} END END AS theoretical FROM g)"""


ORACLE = {
    "mean_var": """SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(var_samp(l_quantity), 4) AS var
      FROM lineitem GROUP BY 1""",
    "min_max": "SELECT " + ", ".join(f"{f}({c}) AS {c}_{f}" for c in MEASURES for f in ("min", "max")) + " FROM lineitem",
    "skew_label": "SELECT feature, round(s, 4) AS skewness, CASE WHEN s > -0.5 AND s < 0.5 THEN 'normal' END AS skewness_label FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, skewness({c}) AS s FROM lineitem" for c in MEASURES)
    + ")",
    "transform_skew": "SELECT feature, transform, round(skewness, 4) AS skewness FROM ("
    + _transform_sql("customer", ["c_acctbal", "c_nationkey"])
    + ")",
    "best_transform": f"""WITH s AS ({_transform_sql("events", ["value"])})
      SELECT feature, arg_min(transform, abs(skewness)) AS transform, round(min(abs(skewness)), 4) AS abs_skewness
      FROM s GROUP BY 1""",
    "guarded_transforms": """SELECT event_id, round(sqrt(abs(value)), 6) AS root,
      round(CASE WHEN value <> 0 THEN 1.0::DOUBLE / value END, 6) AS inverse,
      round(CASE WHEN value > 0 THEN ln(value) END, 6) AS log FROM events""",
    "corr_long": _corr_sql("lineitem", MEASURES, False),
    "corr_high": f"SELECT * FROM ({_corr_sql(NET_SQL, [*MEASURES, 'net'], True)}) WHERE corr > 0.95 AND feature_a <> feature_b",
    "corr_target": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS corr FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
    "phi_coefficient": "SELECT round(corr(quality, toxic), 6) AS phi FROM labels",
    "exact_quantiles": "SELECT l_returnflag, "
    + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}" for n, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
    )
    + " FROM lineitem GROUP BY 1",
    "box_stats": f"""WITH o AS (SELECT o_orderstatus, year(o_orderdate) AS year, o_totalprice AS v FROM orders),
      {FENCES_SQL.format(keys="o_orderstatus, year", v="v", src="o")}
      SELECT o_orderstatus, year, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
        round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
        round(max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
        count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
      FROM o JOIN q USING (o_orderstatus, year) GROUP BY o_orderstatus, year, q1, median, q3""",
    "box_outliers": f"""WITH {FENCES_SQL.format(keys="event_type", v="value", src="events")}
      SELECT event_id, event_type, value FROM events JOIN q USING (event_type)
      WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "qq_points": f"""WITH {_points_sql("customer", "c_acctbal", "c_custkey")}
      SELECT feature, c_custkey, round(theoretical, 6) AS theoretical, ordered FROM points""",
    "qq_fit": f"""WITH {_points_sql("orders", "o_totalprice", "o_orderkey")}
      SELECT feature, round(regr_slope(ordered, theoretical), 4) AS slope,
        round(regr_intercept(ordered, theoretical), 4) AS intercept, round(corr(ordered, theoretical), 4) AS r
      FROM points GROUP BY 1""",
    "monotonic": """SELECT event_type, bool_and(coalesce(ts >= before, TRUE)) AS monotonic FROM (
      SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) GROUP BY 1""",
    "redundant_measures": "SELECT "
    + ", ".join(f"{f}({c}) AS {c}_{f}" for c in MEASURES for f in ("min", "max"))
    + " FROM lineitem",
    "rare_flags": "SELECT p_partkey, CAST(p_type = 'PROMO' AS INTEGER) AS is_promo FROM part",
    "fill_const_mean": f"""WITH {READINGS_SQL}
      SELECT event_id, event_type, coalesce(kind, 'unknown') AS kind, coalesce(reading, 0) AS reading,
        round(coalesce(reading, avg(reading) OVER ()), 4) AS by_mean,
        round(coalesce(reading, avg(reading) OVER (PARTITION BY event_type)), 4) AS by_type_mean FROM readings""",
    "impute_median_mode": f"""WITH {READINGS_SQL},
      m AS (SELECT kind FROM readings WHERE kind IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, kind LIMIT 1)
      SELECT event_id, coalesce(kind, (SELECT kind FROM m)) AS kind,
        round(coalesce(reading, (SELECT median(reading) FROM readings)), 4) AS reading FROM readings""",
    "sentinel_check": "SELECT min(c_acctbal) AS c_acctbal, min(c_nationkey) AS c_nationkey FROM customer",
    "sentinel_repair": """SELECT p_partkey, nullif(p_size, 50) AS p_size,
      CASE WHEN p_size = 50 THEN (SELECT CAST(trunc(median(nullif(p_size, 50))) AS INTEGER) FROM part) ELSE p_size END
      AS size_or_median FROM part""",
}
