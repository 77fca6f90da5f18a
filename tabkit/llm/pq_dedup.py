"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors are folded first. A bounded sample trains the coarse centroids
and the subspace codebooks; every vector is indexed. A vector y that links with
x can only lie in another list c if it lies beyond the plane between x's own
centroid and c's. x therefore asks every list whose plane is nearer than
`slack`: the whole linking distance would be a guarantee, but a step of that
length goes along a given direction by more than z * sqrt(s) of it only with the
tail probability of z, if s is the share of that direction in the squared length
of steps. s is measured on the sample, as the share of its strongest direction,
and of that of the differences of its linked pairs where they are as many as the
dimensions. z = 3.5 is the default, few strong directions so lead to the whole
distance, and the tests measure recall against brute force. In a list, distances come from
per-query tables of subspace distances to the codes. A code's own error is
stored with it and added to the limit, so this step loses no link; what passes
is compared exactly. Of two different lists only one asks the other, and a link
counts for both ends, so that no pair is compared twice. Vectors are shuffled
and written once, along lists, as blocks of bounded size; a large list is many
blocks and a block may hold many small lists. No vector is sent to the lists
it asks: blocks are met with blocks by reading them again, a file with a file,
so that disk grows with the vectors alone, however many lists they ask. A
block names the lists it holds and those that any of its vectors asks, and
blocks without business with each other are not handed on. Only counts and
spanning forests of links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm.common import components, forest
from tabkit.session import stable

LEAST = 0.9
#: Vectors that train the index at most; all are indexed.
TRAIN_ROWS = 20_000
#: Sample vectors whose links are looked up to measure how even steps are.
PAIR_ROWS = 4096
SUBSPACES, CODES = 8, 64
BLOCK_ROWS = 4096
#: Bytes of the vectors of a block at most, about; queries whose sums are held at a time, as many as a processor's cache takes;
#: pairs compared before their links are counted; edges held before a task folds them; pairs of blocks in a batch.
BLOCK_BYTES, QUERIES, PAIRS, EDGES, BATCH = 2 << 20, 256, 1 << 20, 1 << 21, 8
#: Vectors per file of blocks, files if that gives fewer, and vectors per file beyond. Every file is met with every file.
FILE_ROWS, FILES, MOST_FILE_ROWS = 50_000, 64, 250_000
REACH = 3.5
#: Lists per root of the number of vectors. The pairs compared hardly fall with their number.
LISTS_PER_ROOT = 0.5
MOST_LISTS = 8192
ROUNDS = 8
SEED = 42


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every x to every centre."""
    apart = x @ centres.T
    apart *= -2
    apart += np.einsum("ij,ij->i", x, x)[:, None]
    apart += np.einsum("ij,ij->i", centres, centres)
    return np.maximum(apart, 0, out=apart)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distances to all)."""
    apart = squared(x, centres)
    return apart.argmin(1), apart


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own, _ = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        centres[own[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def strongest(x: np.ndarray) -> float:
    """Share of the squared length of the rows of x that lies along their strongest direction."""
    spread = np.linalg.eigvalsh(x.T @ x)
    return float(spread[-1] / max(spread.sum(), np.finfo(np.float64).tiny))


def share_of_steps(sample: np.ndarray, least: float) -> float:
    """The largest share of a step between linked vectors that one direction takes, as far as the sample shows."""
    share = strongest(sample - sample.mean(axis=0))
    steps, held = [], 0
    for i in range(0, min(len(sample), PAIR_ROWS), 512):
        who, other = np.nonzero(sample[i : i + 512] @ sample.T >= least)
        who, other = who[who + i != other], other[who + i != other]
        steps.append(sample[who + i][:PAIR_ROWS] - sample[other][:PAIR_ROWS])
        held += len(steps[-1])
        if held >= 4 * PAIR_ROWS:
            break
    if held >= sample.shape[1]:
        # so few steps look up to this much more uneven than they are
        share = max(share, strongest(np.concatenate(steps)) / (1 + np.sqrt(sample.shape[1] / held)) ** 2)
    return share


class Index:
    """Coarse centroids and one codebook per subspace, from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, least: float = LEAST, reach: float = REACH, subspaces: int = SUBSPACES, codes: int = CODES):
        rng = np.random.default_rng(SEED)
        self.far = np.sqrt(2 - 2 * least)
        self.slack = min(1.0, reach * np.sqrt(share_of_steps(sample, least))) * self.far
        self.centres = kmeans(sample, lists, rng)
        own, _ = nearest(sample, self.centres)
        rest = sample - self.centres[own]
        self.edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes, rng) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.slim = [book.astype(np.float32) for book in self.books]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per vector: its list, its codes, the error of the code."""
        own, _ = nearest(x, self.centres)
        rest = x - self.centres[own]
        parts = list(zip(self.edges[:-1], self.edges[1:], self.books, strict=True))
        codes = np.stack([nearest(rest[:, a:b], book)[0] for a, b, book in parts], axis=1)
        coded = np.concatenate([book[codes[:, i]] for i, (_, _, book) in enumerate(parts)], axis=1)
        return own, codes.astype(np.uint8), np.linalg.norm(rest - coded, axis=1)

    def asks(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """A flag for each of the given lists that a vector asks; it doesn't ask its own.

        Of two lists the lower asks if their numbers add up to an odd one, else
        the higher; each so asks about half of its neighbours.
        """
        centres, (homes, home) = self.centres[lists], np.unique(own, return_inverse=True)
        apart = np.maximum(np.sqrt(squared(self.centres[homes], centres)), 1e-12)
        rest = x - self.centres[own]
        plane = (squared(x, centres) - np.einsum("ij,ij->i", rest, rest)[:, None]) / (2 * apart[home])
        return (plane <= self.slack) & (((own[:, None] + lists) % 2 == 1) == (own[:, None] < lists)) & (own[:, None] != lists)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per vector: its list, its codes, the error of the code, and a flag for every other list it asks."""
        own, codes, error = self.code(x)
        return own, codes, error, self.asks(x, own, np.arange(len(self.centres)))

    def links(self, cell: int, asked: np.ndarray, codes: np.ndarray, error: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked, member) of one list with cosine >= least."""
        limit = (self.far + error) ** 2 + 1e-4
        # whole numbers of two bytes are summed faster; rounded down and cut at the largest limit they lose no pair
        most = float(limit.max())
        scale = np.float32((1 << 16) // len(self.books) - 1) / np.float32(most)
        room = np.empty((2, len(codes) * min(QUERIES, len(asked))), np.uint16)
        limit, places = np.floor(limit * scale).astype(np.uint16)[:, None], np.ascontiguousarray(codes.T, np.intp)
        found = []
        for i in range(0, len(asked), QUERIES):
            some = asked[i : i + QUERIES]
            rest = (some - self.centres[cell]).astype(np.float32)
            sums, one = (r[: len(codes) * len(some)].reshape(len(codes), len(some)) for r in room)
            for k, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.slim, strict=True)):
                # a table's row holds the distances of one code to all queries
                table = np.minimum(squared(book, np.ascontiguousarray(rest[:, a:b])), np.float32(most)) * scale
                np.take(table.astype(np.uint16), places[k], axis=0, out=one if k else sums, mode="clip")
                if k:
                    sums += one
            passed = np.flatnonzero((sums <= limit).ravel())
            if not len(passed):
                continue
            member, who = np.divmod(passed, len(some))
            order = np.argsort(who, kind="stable")
            who, member = who[order], member[order]
            # where much passes, a product of all is cheaper than one of each pair
            cosine = (some @ x.T)[who, member] if 16 * len(who) > sums.size else np.einsum("ij,ij->i", some[who], x[member])
            found.append((who[cosine >= least] + i, member[cosine >= least]))
        who, member = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.intp)]) for i in (0, 1))
        return who, member


def _index_rows(index: Index, dims: int, kind: str):
    """Each vector with its list, its codes and their error."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dims)
            for i in range(0, len(raw), 1024):
                own, codes, error = index.code(unit(raw[i : i + 1024]))
                cut = batch.slice(i, 1024)
                columns = [pa.array(own, pa.int32()), cut.column(0), _binary(raw[i : i + 1024]), cut.column(2), _binary(codes), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "cid", "x", "times", "codes", "error"])

    return mapped, "cell int, cid long, x binary, times long, codes binary, error double"


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _blocks(index: Index, dims: int, kind: str, block_rows: int):
    """Rows in the order of their lists as blocks, with the lists each holds and a bit for every list its vectors ask."""
    words = -(-len(index.centres) // 64)

    def packed(rows: pa.Table) -> pa.RecordBatch:
        own, cid, times, error = (rows.column(c).to_numpy() for c in ("cell", "cid", "times", "error"))
        raw, codes = (b"".join(rows.column(c).to_pylist()) for c in ("x", "codes"))
        x = unit(np.frombuffer(raw, kind).reshape(-1, dims))
        asks = np.zeros(words * 64, bool)
        for i in range(0, len(x), 1024):
            asks[: len(index.centres)] |= index.asks(x[i : i + 1024], own[i : i + 1024], np.arange(len(index.centres))).any(axis=0)
        columns = [pa.array(cid[:1]), pa.array([np.unique(own)], pa.list_(pa.int32())), pa.array([np.packbits(asks, bitorder="little").view("<i8")], pa.list_(pa.int64()))]
        content = b"".join([*(v.astype(f).tobytes() for v, f in ((cid, "<i8"), (times, "<i8"), (error, "<f8"), (own, "<i4"))), raw, codes])
        return pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary())], names=["block", "lists", "asks", "content"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, block_rows - n))
                n, batch = n + len(held[-1]), batch.slice(block_rows - n)
                if n == block_rows:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return mapped, "block long, lists array<int>, asks array<long>, content binary"


class _Block:
    """The content of a block as arrays, with the links found so far of each vector."""

    def __init__(self, content: bytes, dims: int, kind: str, books: int):
        widths = (("<i8", 1), ("<i8", 1), ("<f8", 1), ("<i4", 1), (kind, dims), (np.uint8, books))
        n, at, parts = len(content) // sum(np.dtype(f).itemsize * w for f, w in widths), 0, []
        for form, width in widths:
            parts.append(np.frombuffer(content, form, n * width, at).reshape(n, width))
            at += parts[-1].nbytes
        self.cid, self.times, self.error, self.own = (part.ravel() for part in parts[:4])
        self.x, self.codes = unit(parts[4]), parts[5]
        self.lists, starts = np.unique(self.own, return_index=True)  # own rises
        self.runs = list(zip(self.lists, starts, [*starts[1:], len(self.own)], strict=True))
        self.links = np.zeros(len(self.cid))


class _Tally:
    """Links and edges of a task, folded to one row per linked vector."""

    def __init__(self):
        self.links: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, block: _Block) -> None:
        cid, links = self.links.setdefault(int(block.cid[0]), (block.cid, np.zeros(len(block.cid))))
        links += block.links

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.held += len(a)
        if self.held > EDGES:
            nodes, root = self._folded()
            self.edges = [(nodes[nodes != root], root[nodes != root])]
            self.held = min(len(nodes), EDGES // 2)  # a forest that is large itself is not folded at once again

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([e[i] for e in self.edges] or [np.zeros(0, np.int64)]) for i in (0, 1))
        nodes, local = np.unique(np.concatenate([a, b]), return_inverse=True)
        return nodes, nodes[forest(local[: len(a)], local[len(a) :], len(nodes))]

    def rows(self) -> pa.RecordBatch:
        cid, links = (np.concatenate([v[i] for v in self.links.values()] or [np.zeros(0, np.int64)]) for i in (0, 1))
        order = np.argsort(cid[links > 0])
        nodes, root = self._folded()
        assert np.array_equal(nodes, cid[links > 0][order])
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links[links > 0][order].astype(np.int64)), pa.array(root, pa.int64())], names=["cid", "links", "root"])


def spanning(who: np.ndarray, member: np.ndarray, n: int, k: int) -> np.ndarray:
    """Smallest index reached by each of k members and n queries behind them, from links (query, member) in rising order of queries."""
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    asker = np.full(k, -1)
    asker[member[::-1]] = who[::-1]
    held = np.flatnonzero(asker >= 0)
    # the first link of each end joins nearly all where vectors lie close together
    label = forest(np.concatenate([member[first], held]), np.concatenate([who[first], asker[held]]) + k, n + k)
    a, b = label[member], label[who + k]
    open_ = a != b
    return forest(a[open_], b[open_], n + k)[label] if open_.any() else label


def _met(index: Index, dims: int, least: float, kind: str):
    """Pairs of blocks: per linked vector and task the weight of its links, and a root it is joined to."""

    def compared(tally: _Tally, members: _Block, asking: _Block, cell: int, low: int, high: int, who: np.ndarray) -> None:
        """The vectors `who` of `asking` against one list of `members`; a link counts for both ends."""
        step = max(1, PAIRS // (high - low))
        for i in range(0, len(who), step):
            some = who[i : i + step]
            asked, member = index.links(cell, asking.x[some], members.codes[low:high], members.error[low:high], members.x[low:high], least)
            if asking is members:  # a list against itself: each pair once
                other = some[asked] < member + low if asking.own[some[0]] == cell else slice(None)
                asked, member = asked[other], member[other]
            if not len(asked):
                continue
            asking.links[some] += np.bincount(asked, weights=members.times[low:high][member], minlength=len(some))
            members.links[low:high] += np.bincount(member, weights=asking.times[some][asked], minlength=high - low)
            label = spanning(asked, member, len(some), high - low)
            cid = np.concatenate([members.cid[low:high], asking.cid[some]])
            ends = np.zeros(len(cid), bool)
            ends[member], ends[asked + (high - low)] = True, True
            tally.join(cid[ends], cid[label[ends]])

    def meet(tally: _Tally, members: _Block, asking: _Block, own: bool) -> None:
        asks = index.asks(asking.x, asking.own, members.lists)
        for i, (cell, low, high) in enumerate(members.runs):
            if len(who := np.flatnonzero(asks[:, i])):
                compared(tally, members, asking, cell, low, high, who)
            if own and len(who := np.flatnonzero(asking.own == cell)):
                compared(tally, members, asking, cell, low, high, who)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, left = _Tally(), None
        for batch in batches:
            for row in batch.to_pylist():
                if left is None or left.cid[0] != row["a_block"]:
                    if left is not None:
                        tally.add(left)
                    left = _Block(row["a_content"], dims, kind, len(index.books))
                if row["a_block"] == row["b_block"]:
                    meet(tally, left, left, True)
                    continue
                right = _Block(row["b_content"], dims, kind, len(index.books))
                meet(tally, left, right, True)
                meet(tally, right, left, False)
                tally.add(right)
        if left is not None:
            tally.add(left)
            yield tally.rows()

    return mapped, "cid long, links long, root long"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _pairs(blocks: DataFrame, files: int) -> DataFrame:
    """Blocks (a_ and b_ before their columns) that have business with each other, each two once, by reading files against files."""
    a, b = (blocks.coalesce(files).select([F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "ab")

    asked = "exists({0}_lists, c -> shiftright({1}_asks[int(c div 64)], int(c % 64)) & 1 = 1)"
    business = F.expr(asked.format("a", "b")) | F.expr(asked.format("b", "a")) | F.arrays_overlap("a_lists", "b_lists")
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_block") <= F.col("b_block")) & business)
    return met.select("a_block", "b_block", "a_content", "b_content")


def _names(vector: str) -> list[Column]:
    """Two hashes of a vector, null for none; equal components hash alike, 0.0 and -0.0 too."""
    return [F.when(F.col(vector).isNotNull(), F.xxhash64(F.lit(i), vector)).alias(f"__h{i}") for i in (1, 2)]


def near_vectors(rows: DataFrame, least: float = LEAST, reach: float = REACH, train_rows: int = TRAIN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of `rows` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, as do vectors of different lengths. Equal vectors link
    with each other by definition and share their other links. Repeated rows
    count one by one. component_id is the smallest vec_id reached; null ids
    count as links but never name a component. kept is true where vec_id equals
    component_id, and for a null id on its own or linked with null ids only. An
    empty table gives an empty result.
    """
    spark = rows.sparkSession
    flawed = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & ~flawed & F.exists("embedding", lambda v: v != 0), F.lit(False))
    judged = rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
    grouped = judged.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    # from here on two hashes stand for a vector: two of 2**50 vectors share both with a chance of one in 2**28
    folded = stable(grouped.select("*", *_names("embedding")).withColumn("cid", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")))
    sizes = {r["dims"]: r["count"] for r in folded.groupBy("dims").count().collect()}
    # vectors travel as given; floats take half the room of doubles
    kind = "<f4" if dict(folded.dtypes)["embedding"] == "array<float>" else "<f8"
    found = None
    for dims, n in sorted(sizes.items()):
        same = folded.where(F.col("dims") == dims)
        lists = int(min(MOST_LISTS, max(1, LISTS_PER_ROOT * n**0.5)))
        share = min(1.0, train_rows / n)
        drawn = same.where(F.shiftrightunsigned(F.xxhash64("embedding"), 11) / F.lit(float(1 << 53)) <= share).select("embedding").limit(2 * train_rows).toPandas()
        sample = unit(np.array(drawn["embedding"].tolist() or [[1.0] * dims]))
        index = Index(sample, lists, least, reach)
        files = max(12, min(FILES, n // FILE_ROWS), n // MOST_FILE_ROWS)
        mapped, schema = _index_rows(index, dims, kind)
        entries = same.select("cid", "embedding", "times").mapInArrow(mapped, schema)
        # finding the lists twice, the first time for the bounds, is cheaper than a second copy of all vectors
        placed = entries.repartitionByRange(files, "cell", "cid").sortWithinPartitions("cell", "cid")
        mapped, schema = _blocks(index, dims, kind, max(1, min(block_rows, BLOCK_BYTES // (dims * int(kind[-1])))))
        # vectors don't shrink, and reading a compressed file again and again leaves buffers outside the heap behind
        with _setting(spark, "spark.sql.parquet.compression.codec", "uncompressed"):
            blocks = stable(placed.mapInArrow(mapped, schema))
        met, out = _met(index, dims, least, kind)
        with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH)):
            part = stable(_pairs(blocks, files).mapInArrow(met, out))
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "cid long, links long, root long")
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    slim = folded.select("__h1", "__h2", "least", "times", "cid")
    rooted = slim.join(joined, F.col("cid") == F.col("node"), "left").select("__h1", "__h2", "least", "times", "cid", F.coalesce("component", "cid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").join(counted, "cid", "left").select("__h1", "__h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"))
    linked = judged.select("vec_id", *_names("embedding")).join(known, ["__h1", "__h2"], "left")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
        # without an id: kept on its own, or where nothing it reaches has an id either
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.col("component_id").isNull() | (F.coalesce("n_links", F.lit(0)) == 0)).alias("kept"),
    )
