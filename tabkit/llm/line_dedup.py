"""Line dedup by distinct-site spread, in DataFrame operations only.

A line that many sites share is boilerplate, however rare it is on each. Every
line hash gets a HyperLogLog sketch of its sites, merged by aggregation, so a
line on a third of all pages costs one sketch per task. Lines whose estimate is
further from the threshold than the sketch can err are decided by it; those
near the threshold get an exact distinct count. Pages lose the lines found and
keep all others, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.session import small_side, stable

SITES = 10
#: Sketches of 2**12 registers err by about 1.6 %; five times that, and two sites at least, counts as near.
LOG_REGISTERS, NEAR, NEAR_SITES = 12, 0.08, 2

TAGS = "<[^>]*>"


def site(url: str | Column) -> Column:
    """Host of an address in lower case, without port or user; null where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def lines(html: str | Column) -> Column:
    """Text between tags and line ends, in order, without the empty pieces; null has none."""
    html = F.col(html) if isinstance(html, str) else html
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(html, F.lit("")), TAGS, "\n"), "[\r\n]+"), "")


def line_key(line: Column) -> Column:
    return F.xxhash64(line, F.octet_length(line))


def boilerplate(places: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes `line` that occur on at least `sites` distinct sites, from (line, site); null sites don't count."""
    sketched = places.groupBy("line").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"))
    estimated = stable(sketched.select("line", F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= _low(sites)))
    near = estimated.where(F.col("about") < _high(sites)).select("line")
    exact = places.join(small_side(near), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites)
    return estimated.where(F.col("about") >= _high(sites)).select("line").union(exact.select("line"))


def _low(sites: int) -> int:
    return min(sites - NEAR_SITES, int(sites * (1 - NEAR)))


def _high(sites: int) -> int:
    return max(sites + NEAR_SITES, int(sites * (1 + NEAR)) + 1)


def drop_boilerplate(pages: DataFrame, sites: int = SITES) -> DataFrame:
    """`pages` (__row, url, html, others, which pass) with n_lines, n_removed and kept, the lines left.

    Null or empty pages have no lines; pages without a site keep the lines that
    are boilerplate elsewhere out too, but don't count as a site. Repeated rows
    are cleaned one by one. An empty table gives an empty result. Columns of
    the result's names are replaced.
    """
    names = ("n_lines", "n_removed", "kept")
    others = [c for c in pages.columns if c not in ("html", *names)]
    cut = pages.select("__row", site("url").alias("site"), lines("html").alias("lines"))
    # one row per page and line: repeats within a page are folded before the shuffle
    places = stable(cut.select("__row", "site", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line")))
    bad = places.join(small_side(boilerplate(places.select("line", "site"), sites)), "line", "left_semi")
    per_page = bad.groupBy("__row").agg(F.collect_list("line").alias("bad"))
    cleaned = pages.select(*others, lines("html").alias("__lines")).join(per_page, "__row", "left")
    left = F.when(F.col("bad").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("bad", line_key(x))))
    return cleaned.withColumn("kept", left).select(*others, F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("kept")).cast("long").alias("n_removed"), "kept")
