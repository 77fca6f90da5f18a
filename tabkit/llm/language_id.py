"""Language identification by Bayesian fusion of text and page evidence.

Every page has four kinds of evidence: its visible text, the language its
markup declares, its address suffix, and what the rest of its host looks like.
The text gives a likelihood per language from character trigrams, trained on
labelled documents. The other three are learned from all pages by grouped
aggregation of the text's verdicts: how often each declaration and suffix goes
with each language, and a prior per host, smoothed towards its domain's, which
is smoothed towards the overall one. A page's own verdict is taken out of its
host's counts. All logarithms are added; the largest sum names the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tabkit.llm.line_dedup import site
from tabkit.session import small_side, stable

#: Labelled documents that train the text model, dealt evenly to the languages, and what is read of each for training.
TRAIN_DOCS, TRAIN_CHARS = 4000, 4000
#: A language's share of them is never below this, however many languages there are.
LEAST_DOCS = 20
SLOTS = 1 << 16
#: Trigrams of a text are far from independent: their evidence is divided by this.
TEMPER = 20.0
#: Pseudo-counts that tie a host to its domain, a domain to the whole, a declaration or suffix to chance.
HOST_WEIGHT, DOMAIN_WEIGHT, LABEL_WEIGHT = 5.0, 20.0, 1.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def trigrams(text: str) -> np.ndarray:
    """Slots of the character trigrams of the letters of a text, runs of anything else being one space."""
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    code = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(code) < 3:
        return np.array([], np.int64)
    return ((code[:-2] * np.uint64(0x9E3779B1) ^ code[1:-1] * np.uint64(0x85EBCA77) ^ code[2:] * np.uint64(0xC2B2AE3D)) % np.uint64(SLOTS)).astype(np.int64)


def train_text(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each slot per language) from labelled documents.

    Every language of the labels is there. Texts that are equal as far as they
    are read count once per language; each language trains on `most` texts over
    the number of languages, on LEAST_DOCS at least, or on all it has.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.countDistinct("h").alias("n")).collect()}
    names = sorted(texts)
    if not names:
        return names, np.zeros((0, SLOTS))
    each = max(LEAST_DOCS, most // len(names))
    # a hash share first: else every task would send all its texts to be ordered
    shares = docs.sparkSession.createDataFrame([(n, min(1.0, (1.2 * each + 50) / texts[n])) for n in names], "lang string, share double")
    chance = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    drawn = labelled.join(F.broadcast(shares), "lang").where(chance <= F.col("share")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).collect()
    counts = np.full((len(names), SLOTS), 0.5)
    for r in rows:
        np.add.at(counts[names.index(r["lang"])], trigrams(r["text"]), 1)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-12)))


def languages(pages: DataFrame, docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): host, declared, text_language, language, confidence.

    Without text the other evidence decides; without any, the overall share
    does. Null addresses and declarations are values of their own. Repeated
    rows stay. No pages give an empty result; without labelled documents all
    languages are null.
    """
    names, table = train_text(docs, train_docs)
    if not names:
        empty = F.lit(None).cast("string")
        return pages.select("page_id", site("url").alias("host"), empty.alias("declared"), empty.alias("text_language"), empty.alias("language"), F.lit(None).cast("double").alias("confidence"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html in batch.column(3).to_pylist():
                found = trigrams(_HIDDEN.sub(" ", html or ""))
                support = table[:, found].sum(axis=1) / TEMPER if len(found) else np.zeros(len(names))
                support = np.exp(support - support.max())
                out.append((support / support.sum()).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "seen"])

    # the declaration, read natively; "en-GB" declares "en"
    opening = F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]+)", 1)
    declared = F.when(opening != "", F.lower(opening))
    raw = pages.select("page_id", site("url").alias("host"), declared.alias("declared"), "html")
    seen = stable(raw.mapInArrow(judge, raw.select("page_id", "host", "declared").withColumn("seen", F.array(F.lit(0.0))).schema))
    host = F.coalesce("host", F.lit(""))
    known = seen.withColumn("domain", F.substring_index(host, ".", -2)).withColumn("suffix", F.substring_index(host, ".", -1))
    sums = [F.sum(F.col("seen")[i]).alias(f"s{i}") for i in range(len(names))]

    def counted(key: str) -> DataFrame:
        """Summed verdicts per value of a column, as an array."""
        return known.groupBy(key).agg(*sums).select(F.col(key).alias(f"{key}_"), F.array(*[f"s{i}" for i in range(len(names))]).alias(f"by_{key}"))

    joined = known
    for key in ("declared", "suffix", "domain", "host"):
        joined = joined.join(small_side(counted(key)), F.col(key).eqNullSafe(F.col(f"{key}_")), "left").drop(f"{key}_")
    totals = known.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sums)]).first()
    total = max(sum(totals), 1e-12)
    scores = []
    for i in range(len(names)):
        overall = F.lit(max(totals[i], 1e-9) / total)
        sized = lambda by: F.aggregate(by, F.lit(0.0), lambda a, b: a + b)
        own = F.col("seen")[i]
        labels = [_log((F.col(f"by_{k}")[i] - own + LABEL_WEIGHT * overall) / (sized(f"by_{k}") - 1 + LABEL_WEIGHT) / overall) for k in ("declared", "suffix")]
        domain = (F.col("by_domain")[i] - own + DOMAIN_WEIGHT * overall) / (sized("by_domain") - 1 + DOMAIN_WEIGHT)
        prior = (F.col("by_host")[i] - own + HOST_WEIGHT * domain) / (sized("by_host") - 1 + HOST_WEIGHT)
        scores.append(_log(own) + labels[0] + labels[1] + _log(prior))
    listed = F.array(*[F.lit(n) for n in names])
    fused = joined.withColumn("scores", F.array(*scores)).withColumn("most", F.array_max("scores"))
    weight = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("most")))
    return fused.select(
        "page_id",
        "host",
        "declared",
        F.element_at(listed, F.array_position("seen", F.array_max("seen")).cast("int")).alias("text_language"),
        F.element_at(listed, F.array_position("scores", F.col("most")).cast("int")).alias("language"),
        (1 / weight).alias("confidence"),
    )
