"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds postings (term, document row, position), where a term is a
token together with the token after it, or a lone token if some test item is
one word long. Only terms of the test set are stored, which keeps common words
out except where the test set uses them side by side. Every test window is
looked up from its rarest term: the postings of that term, moved back by its
offset, give candidate starts; the second rarest must stand at its own offset;
all other terms are then intersected at theirs. Windows that differ only in the
item they come from are looked up once. Nothing grows with the square of a
document, item or passage: a candidate is one document start and one window.

Proximity matches come from the same postings: a window is near a place if at
most a quarter of its terms are missing there and each other one stands at most
`slack` words from its own offset. With m terms allowed to miss, at least two of
the m + 2 rarest must stand so; their postings vote for starts, and only starts
with two votes are looked up for the remaining terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.llm.common import LOWER, UPPER, numbered
from tabkit.session import small_side, stable

WINDOW = 13
#: Share of hit words, as one in so many, from which a document counts as contaminated.
ONE_IN = 20
#: A proximity match may miss one term in so many, the others may be displaced by so many words.
MISSING_ONE_IN, SLACK = 4, 1
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def tokens(text: str | Column) -> Column:
    """Words in order: letters, digits and everything beyond ASCII, with A-Z in lower case; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def terms(words: Column) -> Column:
    """The pair of each word and its follower, as hashes, in order."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words, terms) and which items hold them (win, item_id)."""
    read = items.select(F.col("item_id").cast("string").alias("item_id"), tokens("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = read.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    lone = F.transform("words", lambda w: F.xxhash64(w, F.lit("alone")))
    named = stable(cut.select("item_id", F.size("words").alias("words"), F.when(F.size("words") == 1, lone).otherwise(terms(F.col("words"))).alias("terms")).distinct())
    named = named.withColumn("win", F.xxhash64("words", "terms"))
    return named.select("win", "words", "terms").distinct(), named.select("win", "item_id").distinct()


def postings(docs: DataFrame, vocabulary: DataFrame, lone: bool) -> DataFrame:
    """The stored index (term, __row, pos) of the documents, for the terms of `vocabulary`."""
    words = docs.select("__row", tokens("text").alias("words"))
    both = words.select("__row", F.posexplode(terms(F.col("words"))).alias("pos", "term"))
    if lone:
        both = both.union(words.select("__row", F.posexplode(F.transform("words", lambda w: F.xxhash64(w, F.lit("alone")))).alias("pos", "term")))
    return stable(both.join(vocabulary, "term", "left_semi"))


def indexed(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings, the windows with their terms from the rarest (win, words, by_df), and the items of each (win, item_id)."""
    wins, holders = windows(items, window)
    wins = stable(wins)
    flat = wins.select("win", "words", F.posexplode("terms").alias("off", "term"))
    lone = bool(wins.where("words = 1").limit(1).count())
    index = postings(docs, small_side(flat.select("term").distinct()), lone)
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(frequency, "term", "left").groupBy("win", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term"))).alias("by_df"))
    return index, stable(ordered), holders


def occurrences(index: DataFrame, ordered: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches (__row, start, words, win)."""
    plan = small_side(ordered.where(F.col("by_df")[0]["df"] > 0))
    first = plan.select("win", "words", "by_df", F.col("by_df")[0]["term"].alias("term"), F.col("by_df")[0]["off"].alias("off"))
    found = index.join(first, "term").select("win", "words", "by_df", "__row", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    single = found.where(F.size("by_df") == 1)
    listed = index.select(F.col("__row").alias("i_row"), F.col("pos").alias("i_pos"), F.col("term").alias("i_term"))
    second = F.get("by_df", F.lit(1))
    pair = (F.col("__row") == F.col("i_row")) & (F.col("start") + second["off"] == F.col("i_pos")) & (second["term"] == F.col("i_term"))
    two = stable(found.where(F.size("by_df") > 1).join(listed, pair, "left_semi"))
    rest = two.select("win", "words", "__row", "start", F.size("by_df").alias("n"), F.explode(F.slice("by_df", 3, WINDOW if window <= WINDOW else window)).alias("next"))
    at = (F.col("__row") == F.col("i_row")) & (F.col("start") + F.col("next.off") == F.col("i_pos")) & (F.col("next.term") == F.col("i_term"))
    full = rest.join(listed, at, "left_semi").groupBy("win", "words", "__row", "start", "n").count().where("count = n - 2")
    short = two.where(F.size("by_df") == 2)
    out = ["__row", "start", "words", "win"]
    return stable(single.select(*out).union(short.select(*out)).union(full.select(*out)))


def proximity(index: DataFrame, ordered: DataFrame, exact: DataFrame, missing_one_in: int = MISSING_ONE_IN, slack: int = SLACK) -> DataFrame:
    """Proximity matches (__row, start, win, n_found) of windows that the row does not hold exactly.

    Every start at which enough terms of the window stand near their offsets;
    one passage so has a few neighbouring starts. A window of fewer than
    `missing_one_in` terms may miss none. `exact` lists the exact matches, which
    are near as well and are not looked up again. Terms met are bits of a long,
    so a window has at most 63 terms.
    """
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    sized = ordered.withColumn("n", F.size("by_df")).withColumn("missing", F.floor(F.col("n") / missing_one_in).cast("int"))
    possible = sized.where(F.size(F.filter("by_df", lambda t: t["df"] == 0)) <= F.col("missing"))
    anchors = possible.select("win", F.least("n", F.col("missing") + 2).alias("n_asked"), "missing", F.posexplode(F.slice("by_df", F.lit(1), F.col("missing") + 2)).alias("i", "t"))
    asked = anchors.where("t.df > 0").select("win", (F.col("n_asked") - F.col("missing")).alias("least"), bit("i").alias("bit"), F.col("t.off").alias("off"), F.col("t.term").alias("term"))
    near = F.explode(F.sequence(F.col("pos") - F.col("off") - slack, F.col("pos") - F.col("off") + slack))
    votes = index.join(small_side(asked), "term").select("win", "__row", "least", "bit", near.alias("start"))
    counted = votes.groupBy("win", "__row", "start").agg(F.bit_count(F.bit_or("bit")).alias("n_voted"), F.max("least").alias("least"))
    agreed = counted.where("n_voted >= least").select("win", "__row", "start", "n_voted")
    open_ = stable(agreed.join(exact.select("win", "__row").distinct(), ["win", "__row"], "left_anti"))
    rest = possible.select("win", "n", "missing", F.expr("slice(by_df, missing + 3, greatest(n - missing - 2, 0))").alias("others"))
    both = open_.join(small_side(rest), "win")
    wanted = both.select("win", "__row", "start", F.posexplode("others").alias("i", "t"))
    places = F.explode(F.sequence(F.col("start") + F.col("t.off") - slack, F.col("start") + F.col("t.off") + slack))
    shifted = wanted.select("win", "__row", "start", bit("i").alias("bit"), F.col("t.term").alias("term"), places.alias("pos"))
    seen = shifted.join(index, ["__row", "term", "pos"], "left_semi").groupBy("win", "__row", "start").agg(F.bit_count(F.bit_or("bit")).alias("n_more"))
    full = both.join(seen, ["win", "__row", "start"], "left").withColumn("n_found", F.col("n_voted") + F.coalesce("n_more", F.lit(0)))
    return stable(full.where("n_found >= n - missing").select("__row", "start", "win", "n_found"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, slack: int | None = SLACK) -> DataFrame:
    """One row per row of `docs` (__row, text and others, which pass but the text): words, hits, items, verdict.

    n_near_items counts the items with a window near some place, exact ones
    included; the verdict rests on exact hits alone. With `slack` None the
    proximity matches are not looked for and the column is absent.

    Null and empty texts have no words and are never contaminated; items
    without words have no window; an item id of null is left out of the list.
    Repeated rows and items are judged one by one. Empty tables on either side
    give an empty result, or one without hits. Columns n_words, n_hit, n_items,
    n_near_items, items_sha256 and contaminated are replaced.
    """
    index, ordered, holders = indexed(docs.select("__row", "text"), items, window)
    found = occurrences(index, ordered, window)
    holders = small_side(holders)
    order = W.partitionBy("__row").orderBy("start")
    spans = found.groupBy("__row", "start").agg(F.max(F.col("start") + F.col("words")).alias("stop"))
    reached = F.coalesce(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("__row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    held = found.select("__row", "win").distinct().join(holders, "win").select("__row", "item_id").distinct()
    listed = held.groupBy("__row").agg(F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    result = hits.join(listed, "__row", "left")
    near = []
    if slack is not None:
        placed = proximity(index, ordered, found, slack=slack).select("__row", "win").union(found.select("__row", "win")).distinct().join(holders, "win")
        result = placed.groupBy("__row").agg(F.count_distinct("item_id").alias("n_near_items")).join(result, "__row", "left")
        near = [F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items")]
    names = ("n_words", "n_hit", "n_items", "n_near_items", "items_sha256", "contaminated")
    kept = [c for c in docs.columns if c not in ("text", *names)]
    counted = docs.select(*kept, F.size(tokens("text")).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(result, "__row", "left").select(
        *kept,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
        *near,
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns; __row is reserved."""
    whole = numbered(docs)
    bad = contamination(whole.select("__row", "text"), items, window, one_in, slack=None).where("contaminated").select(F.col("__row").alias("__bad"))
    return whole.join(small_side(bad), F.col("__row") == F.col("__bad"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
