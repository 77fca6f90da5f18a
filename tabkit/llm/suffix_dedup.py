"""Suffix dedup: which bytes lie in a string of `length` bytes that also starts elsewhere.

Sorting all suffixes of a corpus is out of reach, so only a difference cover
sample is ranked. D is a perfect difference set modulo v: any two positions i, j
have one shift d < v for which i+d and j+d both lie in D modulo v. Strings of
`length` bytes that agree therefore agree at a pair of sample positions on at
least length - v + 1 bytes, the *depth*.

1. Samples. Every sample position gets the name of its first `depth` bytes, and
   names are dealt to buckets. Each task sorts the names of its buckets, one
   block of suffixes at a time, so memory is bounded by the bucket, whatever
   the corpus. A position whose name occurs again is kept. Names travel as 48
   bits here: a false tie costs a comparison in step 2 and decides nothing.
2. Long ties. Two positions that tie on `depth` bytes are compared in their
   surroundings: all that a repeated string around either could touch. Where
   surroundings recur, all strings around them repeat, and nothing more is
   asked. Where a name has more than one kind of surroundings, at the edges of
   repeated runs, one position of each kind stands for it: each string around
   that one is named by all its `length` bytes (96 bits of hash) and sorted in
   buckets as before.

Copies of whole documents are folded first: if long enough they are repeated
throughout, and one of them stands for all. Names repeated within a batch of
texts are settled there and enter the shuffle once, so a passage that a third
of all documents share costs one entry per batch, not one per occurrence.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import numbered, parts_for
from tabkit.session import run_folder, small_side, stable

LENGTH = 400
FIELD = 4
#: Names sorted at a time in one bucket, about.
BUCKET_NAMES = 1_000_000
SLICE_BYTES = 4 << 20
#: Text held in one bucket of tied texts, about, and the engine's own limit of their number.
TEXT_BYTES = 32 << 20
MAX_BUCKETS = 100_000

_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def difference_cover(bits: int = FIELD) -> tuple[int, np.ndarray]:
    """(v, D) by Singer's rule: v = q*q + q + 1 and q + 1 members, for q = 2**bits.

    D holds the exponents modulo v of the elements of the field with q**3
    members whose trace into the field with q members is zero.
    """
    q, degree = 2**bits, 3 * bits
    v = q * q + q + 1

    def times(a: int, b: int, modulus: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a <<= 1
            if a >> degree:
                a ^= modulus
            b >>= 1
        return out

    for modulus in range((1 << degree) + 1, 2 << degree, 2):
        powers, x = [], 1
        for _ in range(q**3 - 1):
            powers.append(x)
            x = times(x, 2, modulus)
            if x == 1:
                break
        if len(powers) == q**3 - 1:  # 2 generates the whole field
            break

    def trace(i: int) -> int:
        return powers[i] ^ powers[i * q % len(powers)] ^ powers[i * q * q % len(powers)]

    return v, np.array([i for i in range(v) if trace(i) == 0], np.int64)


def names(words: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """A 64-bit name of the `length` bytes at each position; `words` holds the eight bytes from every position on."""
    # the last word overlaps the one before when the length is no multiple of eight
    out = np.full(len(at), which + length, np.uint64)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out ^= words[at + k]
        out *= _K[which]
        out ^= out >> np.uint64(29)
    return out * _K[1 - which] ^ (out >> np.uint64(32))


def _words(data: bytes) -> np.ndarray:
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class _Batch:
    """Names of one batch of texts, settled as far as the batch goes."""

    def __init__(self, length: int, wide: bool, buckets: int):
        self.length, self.wide, self.buckets = length, wide, buckets
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, row: int, data: bytes, at: np.ndarray, repeated: bool) -> None:
        for i in range(0, len(at), SLICE_BYTES // 8):
            part = at[i : i + SLICE_BYTES // 8]
            words = _words(data)
            a = names(words, part, self.length, 0)
            b = (names(words, part, self.length, 1) >> np.uint64(32)).astype("<u4") if self.wide else np.zeros(0, "<u4")
            self.found.append((a, b, part.astype("<u4"), np.full(len(part), row, np.int64), np.full(len(part), repeated)))
            self.size += len(part)

    def rows(self) -> pa.RecordBatch:
        out: dict[str, list] = {"bucket": [], "row": [], "known": [], "known_b": [], "name": [], "name_b": [], "rows": [], "at": []}
        if self.found:
            a, b, at, row, whole = (np.concatenate(x) for x in zip(*self.found, strict=True))
            order = np.lexsort((b, a)) if self.wide else np.argsort(a, kind="stable")
            a, at, row, whole = a[order], at[order], row[order], whole[order]
            b = b[order] if self.wide else b
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) if self.wide else a[1:] != a[:-1]])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            known = (np.diff(np.append(first, len(a))) > 1) | np.logical_or.reduceat(whole, first)
            # what recurs in this batch is settled; copied texts need no answer
            settled = known[group] & ~whole
            for r, places in _by_row(row[settled], at[settled]):
                self._put(out, int(r) % self.buckets, row=int(r), at=places.tobytes())
            bucket = (a[first] % np.uint64(self.buckets)).astype(np.int64)
            shown = (lambda x: x.tobytes()) if self.wide else _short
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                mine = order[edges[k] : edges[k + 1]]
                told, asking = first[mine[known[mine]]], first[mine[~known[mine]]]
                # in text order, equal rows and rising positions compress well
                asking = asking[np.lexsort((at[asking], row[asking]))]
                wide = {"known_b": b[told].tobytes(), "name_b": b[asking].tobytes()} if self.wide else {}
                self._put(out, int(k), known=shown(a[told]), name=shown(a[asking]), rows=_pack(row[asking], "<i8"), at=_pack(at[asking], "<i8"), **wide)
        self.found, self.size = [], 0
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    @staticmethod
    def _put(out: dict[str, list], bucket: int, **values) -> None:
        for key, column in out.items():
            column.append(bucket if key == "bucket" else values.get(key))


def _short(name: np.ndarray) -> bytes:
    """The upper 48 bits of each name."""
    return name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers in their order as compressed steps: equal rows and rising positions take little room."""
    steps = np.diff(values.astype(kind), prepend=np.zeros(1, kind)).tobytes()
    return len(steps).to_bytes(8, "little") + pa.compress(steps, codec="zstd", asbytes=True)


def _unpack(packed: bytes | None, kind: str) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    steps = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(steps, kind))


def _by_row(row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    if len(row):
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for low, high in zip(edges, np.append(edges[1:], len(row)), strict=True):
            yield row[low], at[low:high]


def _settle(held: list[dict], wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positions whose names occur more than once in the buckets of one task."""

    def joined(key: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(x[key] or b"", kind) for x in held]) if held else np.array([], kind)

    def named(key: str) -> np.ndarray:
        if wide:
            return joined(key, "<u8")
        short = joined(key, np.uint8).reshape(-1, 6)
        out = np.zeros((len(short), 8), np.uint8)
        out[:, 2:] = short
        return out.view("<u8").ravel()

    ask, told = named("name"), named("known")
    a = np.concatenate([ask, told])
    row, at = (np.concatenate([_unpack(x[key], "<i8") for x in held]) if held else np.zeros(0, "<i8") for key in ("rows", "at"))
    at = at.astype("<u4")
    if wide:
        b = np.concatenate([joined("name_b", "<u4"), joined("known_b", "<u4")])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.array([], bool)
    else:
        order = np.argsort(a, kind="stable")
        a = a[order]
        new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.array([], bool)
    first = np.flatnonzero(new)
    again = np.diff(np.append(first, len(a))) > 1
    is_told = order >= len(ask)
    if len(first):
        again |= np.logical_or.reduceat(is_told, first)
    answer = order[again[np.cumsum(new) - 1] & ~is_told] if len(a) else np.array([], np.int64)
    return row[answer], at[answer]


def _answers(found: list[tuple[np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    """Rows and positions, one record per group of texts."""
    row, at = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
    group = row % groups
    order = np.lexsort((at, row, group))
    row, at, group = row[order], at[order], group[order]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
    spans = list(zip(edges[:-1], edges[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(group[i]) for i, _ in spans], pa.int32())] + [pa.array([_pack(x[i:j], "<i8") for i, j in spans], pa.binary()) for x in (row, at)],
        names=["group", "rows", "at"],
    )


def _gather(answers: pa.Table) -> pa.Table:
    """The packed positions of every text of one group."""
    row, at = (np.concatenate([_unpack(x.as_py(), "<i8") for x in answers.column(c)]) for c in ("rows", "at"))
    found = [(int(r), _pack(np.sort(places), "<i8")) for r, places in _by_row(row, at)]
    return pa.table([pa.array([r for r, _ in found], pa.int64()), pa.array([a for _, a in found], pa.binary())], names=["row", "at"])


def _repeated(texts: DataFrame, chosen, length: int, wide: bool, buckets: int, groups: int) -> DataFrame:
    """(row, at): per text, the chosen positions whose `length` bytes occur more than once, as packed numbers.

    `texts` has row, text, whole (the text has copies) and marks; `chosen` gives
    the positions to name from the number of bytes and the marks. Answers travel
    by group of texts, so that their records don't multiply with the buckets.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            work = _Batch(length, wide, buckets)
            rows, content, whole, marks = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                data = content[i].as_py().encode()
                at = chosen(len(data), marks[i].as_py())
                for low in range(0, len(at), BUCKET_NAMES):
                    work.add(rows[i].as_py(), data, at[low : low + BUCKET_NAMES], whole[i].as_py())
                    if work.size >= BUCKET_NAMES:
                        yield work.rows()
            yield work.rows()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = [], [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if x["row"] is None:
                    held.append(x)
                    continue
                places = np.frombuffer(x["at"], "<u4")
                found.append((np.full(len(places), x["row"], np.int64), places))
                size += len(places)
                if size > BUCKET_NAMES:
                    yield _answers(found, groups)
                    found, size = [], 0
        found.append(_settle(held, wide))
        yield _answers(found, groups)

    named = texts.select("row", "text", "whole", "marks").mapInArrow(
        name, "bucket int, row long, known binary, known_b binary, name binary, name_b binary, rows binary, at binary"
    )
    answers = _dealt(named, buckets).mapInArrow(settle, "group int, rows binary, at binary")
    return answers.groupBy("group").applyInArrow(_gather, "row long, at binary")


def _dealt(named: DataFrame, buckets: int) -> DataFrame:
    """One bucket to a task: by a hash of their numbers several of `buckets` meet in one, and more of them the more there are."""
    return named.repartitionById(buckets, "bucket")


def _strings(marks: Column, reach: int) -> Column:
    """How many positions lie in (mark - reach, mark] for some mark, those before or too near an end of the text included."""
    start = F.struct(F.lit(-reach).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda seen, at: F.struct(at.cast("long").alias("last"), (seen["n"] + F.least(at - seen["last"], F.lit(reach))).alias("n"))
    return F.aggregate(F.array_sort(marks), start, step, lambda seen: seen["n"])


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """`rows` written to the shared folder in buckets of column row, so that joins on it don't move them again.

    Only a table of the catalog keeps its buckets; it lies outside the warehouse and is known by a name of its own.
    """
    spark, name = rows.sparkSession, f"tabkit_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, "row").option("path", f"{run_folder(spark)}/{name}").option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def _places(parts: list | None) -> np.ndarray:
    """Positions, packed by the tasks that found them or as plain numbers."""
    if parts and not isinstance(parts[0], bytes):
        return np.array(parts, np.int64)
    return np.concatenate([_unpack(p, "<i8") for p in parts or []] or [np.zeros(0, np.int64)])


def _cover(total: int, starts: np.ndarray, lengths: int | np.ndarray) -> np.ndarray:
    """Which of `total` bytes lie in [start, start + lengths) for some start, which may be negative."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, np.maximum(starts, 0), 1)
    np.add.at(steps, np.minimum(starts + lengths, total), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of `docs` (__row, text and others, which pass but the text): what repetition removes.

    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    bytes left, in lowercase hex) and kept (those bytes). A string counts as
    repeated if it starts anywhere else in the table, the same text included,
    and overlaps count. Null and empty texts have no bytes and keep none;
    texts shorter than `length` keep all. Rows that repeat each other in full
    lose everything, if long enough. `kept` may end inside a character, so it
    is binary. Columns of the result's names are replaced.
    """
    v, members = difference_cover()
    depth = length - v + 1
    if depth < 8:
        raise ValueError(f"strings of {length} bytes are too short for a cover of {v}")
    names_out = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "whole")
    kept_columns = [c for c in docs.columns if c not in ("text", *names_out)]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = stable(docs.select(F.col("__row").alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("h"), F.crc32(text).alias("c")))
    long_rows = slim.where(F.col("n_bytes") >= length)
    folded = long_rows.groupBy("h", "c", "n_bytes").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stable(long_rows.join(folded, ["h", "c", "n_bytes"]).select("row", (F.col("row") == F.col("first")).alias("stands")))
    size = long_rows.agg(F.sum("n_bytes")).first()[0] or 0
    flagged = docs.where(F.octet_length("text") >= length).select(F.col("__row").alias("row"), "text").join(small_side(copies), "row", "left")
    texts = flagged.where("stands is null or stands").select("row", "text", F.col("stands").isNotNull().alias("whole"))

    def samples(total: int, _) -> np.ndarray:
        at = (np.arange(0, total, v)[:, None] + members).ravel()
        return at[at + depth <= total]

    def before(total: int, marks: list[bytes]) -> np.ndarray:
        return np.flatnonzero(_cover(total, _places(marks) - v + 1, v)[: total - length + 1])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        span = length + v - 1
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in ("<i8", "<i8", "<i8", "<i4")]
            for row, content, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at = content.encode(), np.sort(_places(marks))
                words, low = _words(data), at - v + 1
                inner = (low >= 0) & (at + length <= len(data))
                seen = np.zeros(len(at), np.uint64)
                seen[inner] = names(words, low[inner], span, 0)
                for i in np.flatnonzero(~inner):  # cut off by an end of the text: how much counts too
                    start, stop = max(0, int(low[i])), min(len(data), int(at[i]) + length)
                    seen[i] = xxhash.xxh64_intdigest(data[start:stop], (int(at[i]) - start) * span + stop - int(at[i]))
                for column, values in zip(out, (names(words, at, depth, 0).view(np.int64), seen.view(np.int64), np.full(len(at), row), at.astype("<i4")), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["name", "seen", "row", "at"])

    buckets = parts_for(int(size * len(members) / v), BUCKET_NAMES)
    # copied texts ask like others here, so that step 2 names their strings for the rest
    sampled = texts.select("row", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("marks"))
    n_buckets = min(parts_for(size, TEXT_BYTES), MAX_BUCKETS)
    first = _repeated(sampled, samples, depth, False, buckets, 4 * n_buckets)
    marked = stable(first.select("row", F.array("at").alias("marks")))
    # texts without a tie are left out before the shuffle, as long as the ids of the others fit a broadcast
    ids = small_side(marked.select("row"), max_rows=1_000_000)
    tied = _bucketed(texts.join(ids, "row", "left_semi").repartition(n_buckets, "row").join(marked, "row"), n_buckets)
    places = stable(tied.select("row", "text", "marks").mapInArrow(around, "name long, seen long, row long, at int"))
    # folded on the map side: surroundings that a third of all texts share still send one row per task
    here = F.struct("row", "at")
    kinds = stable(places.groupBy("name", "seen").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("first")))
    mixed = kinds.groupBy("name").count().where("count > 1").select("name")
    open_at = kinds.join(mixed, "name", "left_semi").select("first.row", F.col("first.at").alias("open"), F.lit(None).cast("int").alias("sure"))
    sure_at = places.join(kinds.where("n > 1").select("name", "seen"), ["name", "seen"], "left_semi").select("row", F.lit(None).cast("int").alias("open"), F.col("at").alias("sure"))
    of_text = open_at.union(sure_at).groupBy("row").agg(F.collect_list("open").alias("open"), F.collect_list("sure").alias("sure"))
    of_text = stable(of_text)
    # marks at the edges of runs lie apart, and one that stands alone asks for v strings of its own
    left = of_text.agg(F.sum(_strings(F.col("open"), v))).first()[0] or 0
    # the bucketed texts stay where they are, for the strings still open and for the cut
    packed = tied.select("row", "text", "whole").join(of_text.where(F.size("open") > 0).select("row", F.col("open").alias("marks")), "row")
    second = _repeated(packed, before, length, True, parts_for(left, BUCKET_NAMES), 4 * n_buckets)
    starts = second.select("row", F.array("at").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, content, sure, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(content.encode(), np.uint8)
                sure = np.array(sure, np.int64)
                begin = np.concatenate([_places(parts), np.maximum(sure - v + 1, 0)])
                end = np.concatenate([_places(parts), np.minimum(sure, len(data) - length)]) + length
                gone = _cover(len(data), begin, end - begin)
                kept = data[~gone].tobytes()
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (row, int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = of_text.select("row", "sure").join(starts, "row", "left")
    partly = tied.where("not whole").select("row", "text").join(found, "row").select("row", "text", "sure", "starts").mapInArrow(cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    empty = F.lit("").cast("binary")
    gone = copies.join(slim, "row").select("row", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(empty, 256).alias("kept_sha256"), empty.alias("kept"))
    results = gone.union(partly).select(F.col("row").alias("__of"), *[F.col(c).alias(f"__{c}") for c in gone.columns[1:]])
    # hashed before the join, which moves the texts only for those who ask for what is kept
    whole = docs.select(*kept_columns, text.alias("__text"), F.sha2(text.cast("binary"), 256).alias("__own"), F.octet_length(text).cast("long").alias("n_bytes"))
    none = F.lit(0).cast("long")
    return whole.join(results, F.col("__row") == F.col("__of"), "left").select(
        *kept_columns,
        "n_bytes",
        F.coalesce("__n_removed", none).alias("n_removed"),
        F.coalesce("__n_spans", none).alias("n_spans"),
        F.coalesce("__kept_sha256", "__own").alias("kept_sha256"),
        F.coalesce("__kept", F.col("__text").cast("binary")).alias("kept"),
    )
