"""Registered queries: splits, folds, scaling, encoding, preprocessing bundles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabkit.catalog.common import READINGS_SQL, readings, round_columns, table
from tabkit.operators import prep as R
from tabkit.operators import split as L

SEED = 6


def strat_split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return L.stratified_split(orders, "o_orderkey", ["o_orderstatus"], 0.33, SEED)


def strat_split_joint(spark, d):
    return L.stratified_split(table(spark, d, "labels"), "doc_id", ["quality", "toxic"], 0.33, SEED)


def hash_split(spark, d):
    return L.hash_split(table(spark, d, "events").select("event_id", "event_type"), "event_id", 0.33, SEED)


def strat_folds(spark, d):
    return L.stratified_folds(table(spark, d, "labels").select("doc_id", "quality"), "quality", ["doc_id"], 3)


def scale_standard(spark, d):
    base = readings(spark, d).select("event_id", "reading")
    base = base.withColumns({"centred": F.col("reading"), "scaled": F.col("reading")})
    chain = Pipeline(stages=[R.StandardScale(["centred"]), R.StandardScale(["scaled"], with_mean=False)])
    return round_columns(chain.fit(base).transform(base), ["centred", "scaled"])


def scale_minmax(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, d, "lineitem").select("l_orderkey", *columns, F.lit(7.0).alias("constant"))
    return round_columns(R.MinMaxScale([*columns, "constant"]).fit(lines).transform(lines), [*columns, "constant"], 6)


def scale_robust(spark, d):
    columns = ["p_size", "p_retailprice"]
    parts = table(spark, d, "part").select("p_partkey", *columns)
    return round_columns(R.RobustScale(columns).fit(parts).transform(parts), columns, 6)


def scale_box_cox(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return round_columns(R.BoxCox(["value"]).fit(events).transform(events), ["value"], 6)


def one_hot(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    encoded = Pipeline(stages=R.one_hot_stages(["c_mktsegment"])).fit(customers).transform(customers)
    slots = vector_to_array("c_mktsegment_onehot")
    names = R.feature_names(encoded, "c_mktsegment_onehot")
    return encoded.select("c_custkey", *[slots[i].cast("int").alias(n) for i, n in enumerate(names)])


def one_hot_binary(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    out = R.BinaryOneHot(["l_linestatus"], "_flag").fit(lines).transform(lines)
    return out.withColumn("l_linestatus_flag", F.col("l_linestatus_flag").cast("int"))


def column_bundle(spark, d):
    """Scale-then-median numbers, mode-then-one-hot text, a two-category flag and a column as it is."""
    customers = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") < 12, "low").otherwise("high").alias("half"),
        "c_nationkey",
    )
    roles = R.Roles(numeric=["balance"], categorical=["segment"], binary=["half"], passthrough=["c_nationkey"])
    bundled = R.column_bundle(roles).fit(customers).transform(customers)
    slots = vector_to_array("features")
    names = R.feature_names(bundled)
    return bundled.select("c_custkey", *[F.round(slots[i], 4).alias(n) for i, n in enumerate(names)])


def null_flags(spark, d):
    base = readings(spark, d).select("event_id", "reading")
    out = Pipeline(stages=[R.NullFlags(["reading"]), R.MedianImputer(["reading"])]).fit(base).transform(base)
    return round_columns(out, ["reading"])


QUERIES = {
    f.__name__: f
    for f in (
        strat_split, strat_split_joint, hash_split, strat_folds, scale_standard, scale_minmax, scale_robust,
        scale_box_cox, one_hot, one_hot_binary,
        column_bundle, null_flags,
    )
}


def _split_sql(src: str, row_id: str, strata: list[str]) -> str:
    by = ", ".join(strata)
    return f"""WITH c AS (SELECT {by}, count(*) AS n FROM {src} GROUP BY ALL),
      t AS (SELECT *, sum(n) OVER () - ceil(sum(n) OVER () * 0.33::DOUBLE) AS n_train, sum(n) OVER () AS total FROM c),
      e AS (SELECT *, n_train * n / total AS exact FROM t),
      p AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, {by}) AS place,
        n_train - sum(floor(exact)) OVER () AS spare FROM e),
      s AS (SELECT {by}, n - floor(exact) - CASE WHEN place <= spare THEN 1 ELSE 0 END AS n_test FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('{SEED}:' || CAST({row_id} AS VARCHAR))) AS i
        FROM {src})
      SELECT {row_id}, {by}, CASE WHEN i <= n_test THEN 'test' ELSE 'train' END AS role FROM r JOIN s USING ({by})"""


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

ORACLE = {
    "strat_split": _split_sql("orders", "o_orderkey", ["o_orderstatus"]),
    "strat_split_joint": _split_sql("labels", "doc_id", ["quality", "toxic"]),
    "hash_split": f"""SELECT event_id, event_type, CASE WHEN
        ('0x' || substr(md5('{SEED}:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.33::DOUBLE
        THEN 'test' ELSE 'train' END AS role FROM events""",
    "strat_folds": """WITH o AS (SELECT quality, row_number() OVER (ORDER BY min(doc_id)) AS place FROM labels GROUP BY 1),
      sorted AS (SELECT quality, (row_number() OVER (ORDER BY place, doc_id) - 1) % 3 AS deal
        FROM labels JOIN o USING (quality)),
      size AS (SELECT quality, count(*) FILTER (deal = 0) AS a, count(*) FILTER (deal = 1) AS b FROM sorted GROUP BY 1),
      r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS i FROM labels)
      SELECT doc_id, quality, CASE WHEN i <= a THEN 0 WHEN i <= a + b THEN 1 ELSE 2 END AS fold
      FROM r JOIN size USING (quality)""",
    "scale_standard": f"""WITH {READINGS_SQL} SELECT event_id, reading,
        round((reading - avg(reading) OVER ()) / stddev_pop(reading) OVER (), 4) AS centred,
        round(reading / stddev_pop(reading) OVER (), 4) AS scaled FROM readings""",
    "scale_minmax": "SELECT l_orderkey, "
    + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
    + ", 0.0::DOUBLE AS constant FROM lineitem",
    "scale_robust": "SELECT p_partkey, "
    + ", ".join(
        f"""round(({c} - (SELECT median({c}) FROM part))
        / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM part), 6) AS {c}"""
        for c in ("p_size", "p_retailprice")
    )
    + " FROM part",
    "one_hot": "SELECT c_custkey, "
    + ", ".join(f'CAST(c_mktsegment = \'{s}\' AS INTEGER) AS "{s}"' for s in SEGMENTS)
    + " FROM customer",
    "one_hot_binary": """SELECT l_orderkey, l_linenumber, l_linestatus, CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_flag
      FROM lineitem""",
    "column_bundle": """WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b,
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS s, c_nationkey FROM customer),
      m AS (SELECT s AS top FROM c WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1)
      SELECT c_custkey, round((coalesce(b, (SELECT median(b) FROM c)) - (SELECT avg(b) FROM c))
        / (SELECT stddev_pop(b) FROM c), 4) AS balance, """
    + ", ".join(
        f"CAST(coalesce(s, (SELECT top FROM m)) = '{s}' AS DOUBLE) AS \"segment_{s}\"" for s in SEGMENTS[:4]
    )
    + """, CAST(c_nationkey < 12 AS DOUBLE) AS half_flag, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM c""",
    "null_flags": f"""WITH {READINGS_SQL} SELECT event_id, CAST(reading IS NULL AS DOUBLE) AS reading_was_null,
        round(coalesce(reading, (SELECT median(reading) FROM readings)), 4) AS reading FROM readings""",
}
