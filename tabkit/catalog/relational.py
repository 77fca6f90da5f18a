"""Registered queries: projection, recodes, joins, frequencies, ordering, sources."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabkit.catalog.common import READINGS_SQL, WEEKLY_SQL, readings, round_columns, table, weekly_orders
from tabkit.functions import scalars as S
from tabkit.operators import columns as C
from tabkit.operators import joins as J
from tabkit.operators import profile as P
from tabkit.session import shared_folder
from tabkit.sources import tables as IO


def profile_by_target(spark, d):
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    joined = J.join_on(table(spark, d, "orders"), customers, "o_custkey")
    return P.profile_by_target(joined, ["c_mktsegment", "c_nationkey", "o_orderpriority"], "o_orderstatus", "o_orderkey")


PROFILE_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, o_orderstatus, count(o_orderkey) AS count
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3"""
    for c in ("c_mktsegment", "c_nationkey", "o_orderpriority")
)


def value_counts(spark, d):
    return P.value_counts(readings(spark, d), "kind")


def value_counts_pct(spark, d):
    return round_columns(P.value_shares(readings(spark, d), ["kind", "event_type"]), ["percentage"])


def category_counts_null(spark, d):
    return P.category_counts(readings(spark, d), "kind")


def highlight_counts(spark, d):
    return P.flag_above(P.category_counts(table(spark, d, "orders"), "o_orderstatus"))


def two_key_counts(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    joined = J.join_on(table(spark, d, "customer"), nations, "c_nationkey")
    counts = P.key_counts(joined, ["n_name", "c_mktsegment"], "c_custkey")
    return C.rename(counts, {"n_name": "nation", "c_mktsegment": "segment"})


QUESTIONS = {"quality": "Is the document of good quality?", "toxic": "Is the document toxic?"}


def question_response(spark, d):
    answers = table(spark, d, "labels").withColumns({c: S.yes_no(F.col(c)) for c in QUESTIONS})
    return P.question_responses(answers, QUESTIONS)


# codes of an ordered answer scale around its middle
RATING_CODES = {"None": -2, "A little": -1, "Dont know": 0, "Somewhat": 1, "A lot": 2}


def likert_diverging(spark, d):
    names = {i: name for i, name in enumerate(RATING_CODES)}
    part = table(spark, d, "part")
    rated = part.select("p_brand", S.recode(F.floor((F.col("p_size") - 1) / 10).cast("int"), names).alias("type"))
    counts = P.key_counts(rated, ["p_brand", "type"], "type", "value")
    coded = counts.withColumn("type_code", S.recode(F.col("type"), RATING_CODES))
    laid = P.diverging_layout(coded, "p_brand", "type_code", "value")
    laid = round_columns(laid, ["percentage", "percentage_start", "percentage_end"])
    return C.sort_by_category(laid, "type", list(RATING_CODES), "p_brand")


LIKERT_SQL = """WITH c AS (
  SELECT p_brand, CAST((p_size - 1) // 10 AS INTEGER) - 2 AS type_code, count(*) AS value FROM part GROUP BY 1, 2),
s AS (SELECT *, 100.0::DOUBLE * value / sum(value) OVER (PARTITION BY p_brand) AS pct FROM c),
o AS (SELECT p_brand, coalesce(sum(pct) FILTER (type_code IN (-2, -1)), 0)
             + coalesce(sum(pct) FILTER (type_code = 0), 0) / 2 AS shift FROM s GROUP BY 1),
e AS (SELECT s.*, sum(pct) OVER (PARTITION BY s.p_brand ORDER BY type_code) - shift AS pend
      FROM s JOIN o ON s.p_brand = o.p_brand)
SELECT p_brand, ['None', 'A little', 'Dont know', 'Somewhat', 'A lot'][type_code + 3] AS type, value, type_code,
       round(pct, 4) AS percentage, round(pend, 4) AS percentage_end, round(pend - pct, 4) AS percentage_start
FROM e"""


def natural_join(spark, d):
    docs = C.project(table(spark, d, "documents"), ["doc_id", "lang", "source", "n_chars"])
    return J.natural_join(docs, table(spark, d, "labels"))


def multi_key_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    sums = lines.groupBy(*keys).agg(F.sum("l_quantity").alias("key_quantity"))
    return J.join_on(lines, sums, keys)


def _order_sums(spark, d):
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("balance"), F.count(F.lit(1)).alias("n_orders")
    )
    return sums.withColumnRenamed("o_custkey", "custkey")


def combine_first(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("custkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")
    )
    return J.combine_first(customers, _order_sums(spark, d), ["custkey"])


def append_aligned(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.append_columns(customers, _order_sums(spark, d), ["custkey"])


def append_assigned(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.append_columns(customers, _order_sums(spark, d), ["custkey"], assign=True)


ORDER_SUMS_SQL = """m AS (SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) AS balance, count(*) AS n_orders
FROM orders GROUP BY 1)"""


def date_offset_lag(spark, d):
    return J.date_lags(weekly_orders(spark, d), "week", "total", {"lag1": 364, "lag2": 728}, ["priority"])


def recode_flags_clip(spark, d):
    c = F.col
    return table(spark, d, "part").select(
        "p_partkey",
        S.indicator(c("p_brand"), "Brand#2").alias("is_brand_2"),
        S.clip_upper(c("p_size"), 35).alias("size_clipped"),
        S.clip_upper(c("p_retailprice"), 1400.0).alias("price_clipped"),
        S.below(c("p_size"), 4).alias("is_small"),
        S.keep_or(c("p_type"), ["ECONOMY", "STANDARD"]).alias("type_kept"),
        S.recode(c("p_type"), {"ECONOMY": 1, "STANDARD": 2, "PROMO": 5}).alias("type_code"),
    )


def unit_convert_rename(spark, d):
    part = C.drop_columns(table(spark, d, "part"), ["p_name", "p_type"])
    part = C.apply_to(part, ["p_size", "p_retailprice"], S.kelvin)
    return round_columns(
        C.rename(part, {"p_size": "Size in kelvin", "p_retailprice": "Price in kelvin"}),
        ["Size in kelvin", "Price in kelvin"],
    )


def name_selection(spark, d):
    events = table(spark, d, "events")
    chosen = [c for c in C.columns_containing(events, "event", "user") if c in C.columns_except(events, ["event_type"])]
    return C.project(C.only(events, "event_type", "purchase"), chosen)


def key_alignment(spark, d):
    return J.key_mismatch(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


def shape_by_entity(spark, d):
    return C.shape(table(spark, d, "events"), "event_type")


def stacked_tables(spark, d):
    parts = [
        table(spark, d, name).select(
            F.lit(name).alias("party"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance")
        )
        for name, p in (("customer", "c"), ("supplier", "s"))
    ]
    return C.stack_tables(parts)


def date_parts_cyclic(spark, d):
    date = F.col("o_orderdate").cast("date")
    parts = table(spark, d, "orders").select("o_orderkey", date.alias("date")).withColumns(S.date_parts(F.col("date")))
    waves = {}
    for name, period in (("month", 12), ("day", 31), ("quarter", 4), ("season", 4)):
        waves |= S.cyclic(name, F.col(name), period)
    return round_columns(parts.withColumns(waves), list(waves), 6)


def scalar_functions(spark, d):
    c = F.col("c_acctbal")
    out = table(spark, d, "customer").select(
        "c_custkey",
        S.sqrt_abs(c).alias("sqrt_abs"),
        S.reciprocal(c).alias("inverse"),
        S.log_positive(c).alias("log"),
        F.abs(c).alias("absolute"),
        S.truncate(c).alias("whole"),
        F.pow(F.lit(10.0), F.col("c_nationkey") / 10).alias("grid"),
        S.days_before(F.to_date(F.lit("2001-03-01")), F.col("c_nationkey")).alias("earlier"),
        S.parse_date(F.concat(F.lit("19"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-02-28"))).alias("parsed"),
    )
    return round_columns(out, ["sqrt_abs", "inverse", "log", "grid"], 6)


def ordered_head(spark, d):
    week = weekly_orders(spark, d)
    return C.first_rows(C.sort_by_date(week, "week", "priority"), 10, "week", "priority")


def value_order(spark, d):
    counts = P.category_counts(readings(spark, d), "kind")
    return C.sort_descending(counts, "count", "kind")


def _last_year(spark, d):
    lagged = J.date_lags(weekly_orders(spark, d), "week", "total", {"predicted": 364}, ["priority"])
    return lagged.filter(F.col("predicted").isNotNull())


def top_errors(spark, d):
    worst = C.largest_errors(_last_year(spark, d), "predicted", "total", 10, "week", "priority")
    return round_columns(worst, ["abs_error"], 2)


def cross_tab(spark, d):
    out = P.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return round_columns(out, ["pct_F", "pct_O", "pct_P"])


def _new_folder(spark) -> str:
    return os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")


def csv_roundtrip(spark, d):
    customers, folder = table(spark, d, "customer"), _new_folder(spark)
    IO.write_csv(customers, folder, ["c_custkey"])
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return IO.read_keyed_csv(spark, folder, schema, ["c_custkey"])


def parquet_roundtrip(spark, d):
    folder = _new_folder(spark)
    IO.write_table(table(spark, d, "orders"), folder)
    return IO.read_table(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        profile_by_target, value_counts, value_counts_pct, category_counts_null, highlight_counts, two_key_counts,
        question_response, likert_diverging, natural_join, multi_key_join, combine_first, append_aligned,
        append_assigned, date_offset_lag, recode_flags_clip, unit_convert_rename, name_selection, key_alignment,
        shape_by_entity, stacked_tables, date_parts_cyclic, scalar_functions, ordered_head, value_order, top_errors,
        cross_tab, csv_roundtrip, parquet_roundtrip,
    )
}

ORACLE = {
    "profile_by_target": PROFILE_SQL,
    "value_counts": f"WITH {READINGS_SQL} SELECT kind, count(*) AS count FROM readings WHERE kind IS NOT NULL GROUP BY 1",
    "value_counts_pct": f"""WITH {READINGS_SQL}, l AS (
        SELECT 'kind' AS feature, kind AS value FROM readings UNION ALL
        SELECT 'event_type', event_type FROM readings),
      c AS (SELECT feature, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
      SELECT feature, value, count,
             round(100.0::DOUBLE * count / sum(count) OVER (PARTITION BY feature), 4) AS percentage FROM c""",
    "category_counts_null": f"WITH {READINGS_SQL} SELECT kind, count(*) AS count FROM readings GROUP BY 1",
    "highlight_counts": "SELECT o_orderstatus, count(*) AS count, count(*) > 1000 AS highlight FROM orders GROUP BY 1",
    "two_key_counts": """SELECT n_name AS nation, c_mktsegment AS segment, count(c_custkey) AS counts
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "question_response": " UNION ALL ".join(
        f"""SELECT '{text}' AS question, CASE {c} WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'No response' END AS type,
        count(*) AS value FROM labels GROUP BY 2"""
        for c, text in QUESTIONS.items()
    ),
    "likert_diverging": LIKERT_SQL,
    "natural_join": """SELECT doc_id, lang, source, n_chars, quality, toxic
      FROM documents JOIN labels USING (doc_id)""",
    "multi_key_join": """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, key_quantity FROM lineitem
      JOIN (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS key_quantity FROM lineitem GROUP BY 1, 2)
      USING (l_orderkey, l_linenumber)""",
    "combine_first": f"""WITH {ORDER_SUMS_SQL}
      SELECT coalesce(c_custkey, custkey) AS custkey,
             coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, balance) AS balance, n_orders
      FROM customer FULL JOIN m ON c_custkey = custkey""",
    "append_aligned": f"""WITH {ORDER_SUMS_SQL}
      SELECT coalesce(c_custkey, custkey) AS custkey, c_mktsegment, balance, n_orders
      FROM customer FULL JOIN m ON c_custkey = custkey""",
    "append_assigned": f"""WITH {ORDER_SUMS_SQL}
      SELECT c_custkey AS custkey, c_mktsegment, balance, n_orders FROM customer LEFT JOIN m ON c_custkey = custkey""",
    "date_offset_lag": f"""WITH {WEEKLY_SQL}
      SELECT w.priority, w.week, w.total, w.orders, a.total AS lag1, b.total AS lag2 FROM weekly w
      LEFT JOIN weekly a ON a.priority = w.priority AND a.week = w.week - 364
      LEFT JOIN weekly b ON b.priority = w.priority AND b.week = w.week - 728""",
    "recode_flags_clip": """SELECT p_partkey, CAST(p_brand = 'Brand#2' AS INTEGER) AS is_brand_2,
      least(p_size, 35) AS size_clipped, least(p_retailprice, 1400.0::DOUBLE) AS price_clipped,
      CAST(p_size < 4 AS INTEGER) AS is_small,
      CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type ELSE 'o' END AS type_kept,
      CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 5 END AS type_code FROM part""",
    "unit_convert_rename": """SELECT p_partkey, p_brand, round(p_size + 273.15::DOUBLE, 4) AS "Size in kelvin",
      round(p_retailprice + 273.15::DOUBLE, 4) AS "Price in kelvin" FROM part""",
    "name_selection": "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'",
    "key_alignment": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
      CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
      FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l
      ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "shape_by_entity": "SELECT event_type, count(*) AS n_rows, 5 AS n_columns FROM events GROUP BY 1",
    "stacked_tables": """SELECT 'customer' AS party, c_name AS name, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'supplier', s_name, s_acctbal FROM supplier""",
    "date_parts_cyclic": """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS year,
        month(o_orderdate) AS month, day(o_orderdate) AS day, dayofyear(o_orderdate) AS day_of_year,
        quarter(o_orderdate) AS quarter, month(o_orderdate) % 12 // 3 + 1 AS season FROM orders)
      SELECT *, """
    + ", ".join(
        f"round({f}(2 * pi() * {c} / {n}), 6) AS {c}_{f}"
        for c, n in (("month", 12), ("day", 31), ("quarter", 4), ("season", 4))
        for f in ("sin", "cos")
    )
    + " FROM p",
    "scalar_functions": """SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS sqrt_abs,
      round(CASE WHEN c_acctbal <> 0 THEN 1.0::DOUBLE / c_acctbal END, 6) AS inverse,
      round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS log, abs(c_acctbal) AS absolute,
      CAST(trunc(c_acctbal) AS INTEGER) AS whole, round(pow(10.0::DOUBLE, c_nationkey::DOUBLE / 10), 6) AS grid,
      DATE '2001-03-01' - c_nationkey AS earlier,
      CAST('19' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-02-28' AS DATE) AS parsed FROM customer""",
    "ordered_head": f"WITH {WEEKLY_SQL} SELECT * FROM weekly ORDER BY week, priority LIMIT 10",
    "value_order": f"WITH {READINGS_SQL} SELECT kind, count(*) AS count FROM readings GROUP BY 1",
    "top_errors": f"""WITH {WEEKLY_SQL}
      SELECT w.priority, w.week, w.total, w.orders, a.total AS predicted, round(abs(a.total - w.total), 2) AS abs_error
      FROM weekly w JOIN weekly a ON a.priority = w.priority AND a.week = w.week - 364
      ORDER BY abs(a.total - w.total) DESC, w.week, w.priority LIMIT 10""",
    "cross_tab": """WITH c AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "n_F",
        count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P"
        FROM orders GROUP BY 1)
      SELECT *, """
    + ", ".join(f'round(100.0::DOUBLE * "n_{v}" / ("n_F" + "n_O" + "n_P"), 4) AS "pct_{v}"' for v in "FOP")
    + " FROM c",
    "csv_roundtrip": "SELECT * FROM customer",
    "parquet_roundtrip": "SELECT * FROM orders",
}
