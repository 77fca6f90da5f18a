"""SimHash near-duplicates: BK-trees over shards of fingerprints, exact within the radius.

Fingerprints come from one pass over the texts without a shuffle. Equal
fingerprints are folded. Two fingerprints of 64 bits that differ in at most r
bits agree on some m-r of m blocks, so every fingerprint enters one shard per
choice of m-r blocks, and no link is lost. In each shard a BK-tree is grown
(children keyed by their Hamming distance to the parent) and every member walks
it along the edges within the radius. m is chosen from the number of distinct
fingerprints: more blocks mean more copies but far fewer comparisons. A shard
above `shard_rows` is cut into trees, each met by blocks of the shard's
members, so that no task sees more than two blocks. Each task sends on a
spanning forest of its links, never the pairs; components are found by rounds
of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import components, forest, numbered, parts_for
from tabkit.session import small_side, stable

WORDS = 4
RADIUS = 4
BITS = 64
SEED = 42
SHARD_ROWS = 4096
#: Pairs of member and node looked at together in one task.
VISITS_AT_ONCE = 2_000_000
#: Rough costs that choose the number of blocks: a row sent to a shard, a node visited.
ROW_COST, VISIT_COST = 10e-6, 0.3e-6


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the runs of `words` words of one text, in order, repeats included; a shorter text is one run."""
    import xxhash

    # bytes.lower and bytes.split know A-Z and the six ASCII spaces only
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.array([], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    last = max(0, len(parts) - words)
    starts = [0, *(ends[:last] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, last + 1)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text; no words (null, empty, blank): 0."""
    hashes = shingles(text, words)
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` but the text, and the fingerprint as a signed long `fp`."""
    kept = [c for c in docs.columns if c != text]
    slim = docs.select(*kept, F.col(text).alias("__text"))
    schema = docs.select(*kept).withColumn("fp", F.lit(0).cast("long")).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(len(kept))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*kept, "fp"])

    return slim.mapInArrow(mapped, schema)


def grow(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over rows sorted by group, one per group: (root of each row, sorted child keys, child of each key).

    The key of a child is parent * 65 + distance. All rows descend together, a
    level at a time; the first to reach an empty edge becomes its child.
    """
    n = len(prints)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.array([], np.int64)
    root = np.repeat(first, np.diff(np.append(first, n)))
    at, left = root.copy(), np.setdiff1d(np.arange(n), first, assume_unique=True)
    keys, children = [], []
    while len(left):
        key = at[left] * (BITS + 1) + np.bitwise_count(prints[left] ^ prints[at[left]])
        found, where, back = np.unique(key, return_index=True, return_inverse=True)
        keys.append(found)
        children.append(left[where])
        at[left] = left[where][back]
        left = left[at[left] != left]
    if not keys:
        return root, np.array([], np.int64), np.array([], np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def walk(prints: np.ndarray, tree: tuple, asked: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index into asked, node) within the radius; start: the root for each asked fingerprint."""
    _, keys, child = tree
    who, node = np.arange(len(asked)), start
    found = []
    while len(who):
        apart = np.bitwise_count(asked[who] ^ prints[node]).astype(np.int64)
        near = apart <= radius
        found.append((who[near], node[near]))
        low = np.searchsorted(keys, node * (BITS + 1) + np.maximum(apart - radius, 0), "left")
        high = np.searchsorted(keys, node * (BITS + 1) + np.minimum(apart + radius, BITS), "right")
        many = high - low
        go = many > 0
        low, many, who = low[go], many[go], who[go]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        node = child[np.repeat(low, many) + step]
        who = np.repeat(who, many)
    return np.concatenate([f[0] for f in found] or [[]]).astype(np.int64), np.concatenate([f[1] for f in found] or [[]]).astype(np.int64)


def shard_links(group: np.ndarray, prints: np.ndarray, member: np.ndarray, asks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as pairs of fingerprints, of all links within groups from those that ask to members."""
    order = np.argsort(group, kind="stable")
    group, prints, member, asks = group[order], prints[order], member[order], asks[order]
    values, own = np.unique(prints, return_inverse=True)
    tree_group, tree_prints = group[member], prints[member]
    tree = grow(tree_group, tree_prints)
    label = np.arange(len(values))
    if len(tree_group):
        at = np.searchsorted(tree_group, group)
        held = asks & (at < len(tree_group)) & (tree_group[np.minimum(at, len(tree_group) - 1)] == group)
        asking, start = np.flatnonzero(held), at[held]
        size = np.searchsorted(tree_group, group[asking], "right") - start
        # a group of one has no one to meet but itself
        asking, start, size = asking[size + (~member[asking]) > 1], start[size + (~member[asking]) > 1], size[size + (~member[asking]) > 1]
        cuts = np.searchsorted(np.cumsum(size), np.arange(VISITS_AT_ONCE, size.sum() + 1, VISITS_AT_ONCE))
        tree_own = own[member]
        for part in np.split(np.arange(len(asking)), np.unique(cuts)):
            if len(part):
                who, node = walk(tree_prints, tree, prints[asking[part]], start[part], radius)
                a, b = own[asking[part]][who], tree_own[node]
                apart = a != b
                ends = np.flatnonzero(label != np.arange(len(label)))
                label = forest(np.concatenate([a[apart], ends]), np.concatenate([b[apart], label[ends]]), len(values))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """The number of blocks with the least expected work for so many fingerprints."""

    def cost(m: int) -> float:
        copies, bits = comb(m, radius), BITS * (m - radius) / m
        return copies * (distinct * ROW_COST + distinct**2 / 2**bits * VISIT_COST)

    return min(range(radius + 1, radius + 6), key=cost)


def links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` within the radius, as spanning forests."""
    n = prints.count()
    m = blocks_for(n, radius)
    bounds = [BITS * i // m for i in range(m + 1)]
    masks = [sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in chosen) for chosen in combinations(range(m), m - radius)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in enumerate(signed)])
    entries = prints.select("fp", F.explode(keys).alias("at")).select("fp", "at.t", "at.key")
    large = small_side(entries.groupBy("t", "key").count().where(F.col("count") > shard_rows).select("t", "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees")))
    placed = entries.join(large, ["t", "key"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = placed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # tree j is met by block i for all i <= j; in (i, j) the rows of i ask and those of j grow the tree
    other = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    met = own.withColumn("other", other).select(
        "fp",
        F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("shard"),
        (F.col("own") >= F.col("other")).alias("member"),
        (F.col("own") <= F.col("other")).alias("asks"),
    )
    parts = parts_for(n * len(masks), 200_000)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        columns = {name: whole.column(name).to_numpy() for name in whole.column_names}
        a, b = shard_links(columns["shard"], columns["fp"].view(np.uint64), columns["member"].astype(bool), columns["asks"].astype(bool), radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return met.repartition(parts, "shard").mapInArrow(mapped, "a long, b long")


def rooted(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs` (doc_id, text, and any others): the columns but the text, fp, component_id, and __root, the component's own name."""
    printed = stable(fingerprints(docs.drop("fp", "component_id")))
    folded = stable(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(folded.select("fp"), radius))
    named = folded.join(member, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("__root"))
    least = named.groupBy("__root").agg(F.min("least").alias("component_id"))
    return printed.join(named.join(least, "__root").select("fp", "component_id", "__root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text, and any others, which pass): fp and component_id.

    component_id is the smallest doc_id reachable by links, the row's own
    included; null ids are ignored unless a component has no other. Texts
    without words, null ones too, have fingerprint 0. Repeated rows stay. An
    empty table gives an empty result. Columns fp and component_id are replaced.
    """
    if words != WORDS:
        raise ValueError(f"fingerprints take {WORDS} words")
    return rooted(docs, radius).drop("__root")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the smallest doc_id (of repeated ids, one row).

    Ids need not be unique: components are told apart by their fingerprints.
    Null ids come last, and stand for a component only if it has no other id.
    Columns are those of `docs`; __row is reserved.
    """
    whole = numbered(docs)
    found = rooted(whole.select("doc_id", "text", "__row"), radius)
    return best_rows(whole, found)


def best_rows(whole: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `whole` that stand for their `__root` in `found` (doc_id, __row, __root), without __row."""
    # the component's rows fold on the map side, so a hot group costs no more than any other
    best = found.groupBy("__root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("best"))
    kept = best.select(F.col("best.__row").alias("__kept"))
    return whole.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
