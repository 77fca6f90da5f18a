"""Quality rules: an isolation forest over rule statistics, with cuts calibrated on labelled rows.

One pass turns every whole text into counts and shares. A tree isolates rows by
random splits (a statistic at random, a value at random within its range); a
row that is alone after few splits is unlike the others. A text's score is
2^(-mean path / usual path) over all trees: near one for anomalies, below one
half for common texts.

Each tree grows from a sample of its own, drawn by a hash of the text, so that
a thousand copies count as one text; trees grow in parallel, one per group, and
only the trees reach the driver. The share of rows to draw follows from the
count of different texts. Cuts come from a histogram of the scores of all
labelled rows, one per band of lengths, as short texts scatter more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.session import stable

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
TREES, SAMPLE, SEED = 100, 256, 13
#: Words from which a band of lengths begins, the bins of the score, and how many poor texts a good one weighs.
BANDS, BINS, GOOD_WEIGHS = (0, 50, 200, 1000), 2000, 10.0
#: A band with fewer labelled rows of either kind takes the cut of all bands.
LEAST_LABELLED = 30
#: Labelled rows with this remainder of crc32(doc_id) are kept for measuring, as for toxicity.
FOLDS, HELD_OUT = 5, 0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "digits", "other_signs", "bare_words", "different_words"]
_EULER = 0.5772156649015329


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    code, held, size = ids, 1, len(number)
    while held < window:
        # codes of `held` words, followed by those of the next one; renumbered before they could overflow
        code = code[: len(words) - held] * len(number) + ids[held:]
        held, size = held + 1, size * len(number)
        if held < window and size * len(number) >= 1 << 62:
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
    _, back, often = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often[back] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], list[float]]:
    """The counts and shares of one text, of which no part is left out; a null one counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes know the six ASCII spaces only
    signs = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(signs[0x80:0xC0].sum())
    chars = points - int(signs[9:14].sum() + signs[32])
    symbols = int(sum(signs[ord(c)] for c in SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    letters = int(signs[65:91].sum() + signs[97:123].sum() + signs[0xC0:].sum())
    n, digits = len(words), int(signs[48:58].sum())
    counts = [n, chars, symbols, again, repeated]
    shares = [
        min(chars / max(n, 1), 50.0), symbols / max(chars, 1), again / max(len(lines), 1), repeated / max(n, 1),
        int(signs[65:91].sum()) / max(letters, 1), digits / max(chars, 1), (chars - letters - digits) / max(chars, 1),
        sum(len(w) == 1 and not w.isalnum() for w in words) / max(n, 1), min(1.0, len(set(words)) / max(n, 1) ** 0.8),
    ]
    return counts, shares


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, __key (a hash of the text), the counts, and `shares` in the order of SHARES."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__key"), F.col(text).alias("__text"))
    schema = T.StructType([*slim.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [measure(t.as_py()) for t in batch.column(2)]
            counts = np.array([c for c, _ in seen], np.int64).reshape(-1, len(COUNTS))
            shares = pa.array([s for _, s in seen], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(counts[:, i]) for i in range(len(COUNTS))), shares], names=[f.name for f in schema])

    return slim.mapInArrow(mapped, schema)


def usual_path(n) -> np.ndarray:
    """Mean path length of a search that fails in a binary tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + _EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One tree over the rows of x: a line (statistic, value, left child, path) per node; a leaf has statistic -1 and its whole path.

    The right child follows the left one. No node splits below the depth at
    which an average row is alone, nor where all its rows are equal.
    """
    deepest = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, waiting = [[-1.0, 0.0, -1.0, 0.0]], [(0, np.arange(len(x)), 0)]
    while waiting:
        at, rows, depth = waiting.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        varies = np.flatnonzero(high > low)
        if depth >= deepest or not len(varies):
            nodes[at] = [-1.0, 0.0, -1.0, depth + float(usual_path(len(rows)))]
            continue
        which = int(rng.choice(varies))
        value = rng.uniform(low[which], high[which])
        left = x[rows, which] <= value
        if left.all():  # a range so narrow that the draw rounds to its end
            value = low[which]
            left = x[rows, which] <= value
        nodes[at] = [which, value, len(nodes), 0.0]
        waiting += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
        nodes += [[-1.0, 0.0, -1.0, 0.0], [-1.0, 0.0, -1.0, 0.0]]
    return np.array(nodes)


class Forest:
    """Trees end to end in one table, and the usual path by which their paths are measured; picklable and small."""

    def __init__(self, trees: list[np.ndarray], sample: int):
        starts = np.cumsum([0, *(len(t) for t in trees)])[:-1]
        moved = [np.column_stack([t[:, 0], t[:, 1], t[:, 2] + s, t[:, 3]]) for t, s in zip(trees, starts, strict=True)]
        whole = np.concatenate(moved) if moved else np.zeros((0, 4))
        self.roots, self.usual = starts.astype(np.int64), float(usual_path(sample))
        self.which, self.value, self.left, self.path = whole[:, 0].astype(np.int64), whole[:, 1], whole[:, 2].astype(np.int64), whole[:, 3]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1; one half where there is no tree."""
        if not len(self.roots) or not self.usual:
            return np.full(len(x), 0.5)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            which = self.which[at]
            inner = which >= 0
            if not inner.any():
                break
            right = x[row, np.maximum(which, 0)] > self.value[at]
            at = np.where(inner, self.left[at] + right, at)
        return 2.0 ** (-self.path[at].mean(axis=1) / self.usual)


def train(measured: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> Forest:
    """A forest from `measured` (__key, shares): each tree from about `sample` different texts, drawn over all rows by hash.

    The sample is bounded by its parameters: about trees times sample texts are
    drawn, a few per cent off as the count of different texts is estimated.
    """
    distinct = measured.agg(F.approx_count_distinct("__key", 0.02)).first()[0]
    if not distinct:
        return Forest([], sample)
    # each text goes to so many trees on average, whole copies by luck of its hash: none or one where texts abound
    expected = trees * min(1.0, sample / distinct)
    luck = F.shiftrightunsigned(F.xxhash64("__key", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = measured.withColumn("copies", F.floor(F.lit(expected) + luck).cast("int")).where("copies > 0")
    dealt = drawn.select("__key", "shares", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("__key", "copy", F.lit(seed + 1)), F.lit(trees)).cast("int"))
    dealt = dealt.groupBy("tree", "__key").agg(F.first("shares").alias("shares"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        # in the order of the keys, so that a repeated task grows the same tree
        x = np.array(rows.sort_values("__key")["shares"].tolist(), float)[: 2 * sample]
        nodes = grow(x, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "rows": [len(x)], "nodes": [nodes.ravel().tolist()]})

    grown = sorted(dealt.groupBy("tree").applyInPandas(fitted, "tree int, rows long, nodes array<double>").collect(), key=lambda r: r["tree"])
    typical = int(np.mean([r["rows"] for r in grown])) if grown else sample
    return Forest([np.array(r["nodes"]).reshape(-1, 4) for r in grown], typical)


def scored(measured: DataFrame, forest: Forest) -> DataFrame:
    """`measured` with `anomaly` in place of shares; one pass, no shuffle."""
    kept = [c for c in measured.columns if c != "shares"]
    sent = measured.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*(f for f in measured.schema if f.name != "shares"), T.StructField("anomaly", T.DoubleType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = np.concatenate([sent.value.score(x[i : i + 2048]) for i in range(0, len(x), 2048)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[f.name for f in schema])

    return measured.select(*kept, "shares").mapInArrow(mapped, schema)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def band(words: str = "n_words", bands: tuple[int, ...] = BANDS):
    return reduce(lambda found, i: F.when(F.col(words) >= bands[i], i).otherwise(found), range(1, len(bands)), F.lit(0))


def best_cut(good: np.ndarray, poor: np.ndarray, weight: float = GOOD_WEIGHS) -> float:
    """The score from which a text is rejected, given counts per bin: few good texts lost, each weighing as `weight` poor ones.

    In the middle of the equally good cuts; 2 (no text at all) if either kind is missing.
    """
    if not good.sum() or not poor.sum():
        return 2.0
    lost = np.append(np.cumsum(good[::-1])[::-1], 0) / good.sum()
    caught = np.append(np.cumsum(poor[::-1])[::-1], 0) / poor.sum()
    gain = caught - weight * lost
    ties = np.flatnonzero(gain >= gain.max() - 1e-12)
    first = ties[0]
    last = first + int(np.argmin(np.append(np.diff(ties) == 1, False)))
    return float((first + last) / 2 / len(good))


def calibrated(rows: DataFrame, labels: DataFrame, bands: tuple[int, ...] = BANDS, weight: float = GOOD_WEIGHS) -> list[float]:
    """One cut per band from the labelled rows (doc_id, quality) among `rows` (doc_id, n_words, ..., anomaly).

    The driver sees a histogram: bands times bins times two numbers. Labels of
    held-out ids, null ids and null labels are not used; contradicting labels count both.
    """
    usable = labels.where("quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    usable = usable.select(F.col("doc_id").alias("__id"), (F.col("quality") > 0).alias("good")).distinct()
    asked = rows.where(~base_failed()).select("doc_id", band(bands=bands).alias("band"), F.floor(F.least(F.col("anomaly"), F.lit(1 - 1e-9)) * BINS).cast("int").alias("bin"))
    counts = np.zeros((2, len(bands), BINS))
    for r in asked.join(usable, F.col("doc_id") == F.col("__id")).groupBy("band", "bin", "good").count().collect():
        counts[int(r["good"]), r["band"], r["bin"]] = r["count"]
    common = best_cut(counts[1].sum(axis=0), counts[0].sum(axis=0), weight)
    enough = (counts.sum(axis=2) >= LEAST_LABELLED).all(axis=0)
    return [best_cut(counts[1, b], counts[0, b], weight) if enough[b] else common for b in range(len(bands))]


def judged(docs: DataFrame, labels: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, the counts, base_failed, anomaly and kept.

    kept: base rules passed and the anomaly is below the cut of the text's band.
    Null and empty texts have no words and fail the base rules. Repeated rows
    and null ids stay. Without labels of both kinds nothing but the base rules
    rejects. Other columns of `docs` are not carried, whatever their names. An
    empty table gives an empty result.
    """
    measured = stable(statistics(docs))
    rows = stable(scored(measured, train(measured, trees, sample, seed)).drop("__key"))
    cuts = calibrated(rows, labels, bands)
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), band(bands=bands) + 1)
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), "anomaly", (~base_failed() & (F.col("anomaly") < cut)).alias("kept"))
