"""Cross-tokenizer alignment by interval coalescing.

Every token covers a range of bytes. The tokens of both sides are sorted by
where they start, and a running maximum of where they end goes along: a group
ends where the next token starts at or beyond that maximum, which is where
tokens of both sides end together. Within a group overlapping tokens are
expanded to pairs.

A text is cut before single spaces at which both tokenizers are known to start
anew, so a group never crosses a cut and a text's alignment is that of its
parts, one after the other. Parts repeat heavily: each worker keeps the
alignments of those it has met, in a table of bounded size, and encodes and
coalesces only new ones, many at a time. Pairs are counted per text before they
leave the worker. For the counts over the whole corpus, pairs are summed by
aggregation; the commonest, a bounded number, are broadcast, and only the rest
of the entries is shuffled to meet its counts, so no pair is hot.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import numbered
from tabkit.session import small_side, stable

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The left side's id in the high half of a pair, the right side's in the low half.
SHIFT = 32
#: Within a side, before the right side, between groups.
MARKS = ",|;"
BATCH_BYTES = 1 << 19
#: Parts the left side encodes as one text, cut again by the bytes of its tokens.
TOGETHER = 64
#: Alignments kept per worker (those met last, and as many met before them), and the longest part worth keeping.
KNOWN_PARTS, KNOWN_CHARS = 200_000, 64
#: Pairs that may be broadcast: so many, of three numbers each.
HOT_PAIRS = 100_000

#: A space after neither a space nor the space mark and before something else than white space.
_CUT = re.compile(r"(?<=[^ ▁]) (?=[^\s᠎])")
_WORKER: dict = {}


@dataclass(slots=True)
class Aligned:
    """What is known of one part; pairs as codes, once for each time they are linked."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: tuple[int, ...]
    #: Joined bytes of both sides, if they are not the part's own.
    wrong: tuple[bytes, bytes] | None = None


class Pair:
    """Both tokenizers and the bytes of their tokens, loaded once per worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            kind = json.load(f)["pre_tokenizer"]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex") or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("these vocabularies join words, so texts can't be cut at spaces")
        byte_of = _byte_of_sign()
        special = {i for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [entries[i].encode() if i in special else bytes(byte_of[c] for c in entries[i]) for i in range(len(entries))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.known: dict[str, dict[str, Aligned]] = {"overlaps": {}, "ends": {}}
        self.older: dict[str, dict[str, Aligned]] = {"overlaps": {}, "ends": {}}

    def align(self, parts: list[str], linked: str) -> list[Aligned]:
        """Alignments of distinct parts, coalesced all at once."""
        spaced = [" " + p for p in parts]
        ids = self._left(spaced), self.b.encode(parts, num_threads=1)
        sides = [np.fromiter(chain.from_iterable(side), np.int64) for side in ids]
        counts = [np.fromiter(map(len, side), np.int64, len(parts)) for side in ids]
        sizes = [size[side] for size, side in zip((self.size_a, self.size_b), sides)]
        # all tokens are joined once, and cut where each part ends
        joined = [b"".join(map(entries.__getitem__, side.tolist())) for entries, side in zip((self.bytes_a, self.bytes_b), sides)]
        edges = [np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n))].tolist() for size, n in zip(sizes, counts)]
        found: list[Aligned | None] = [None] * len(parts)
        sound = np.ones(len(parts), bool)
        for i, (p, low_a, high_a, low_b, high_b) in enumerate(zip(spaced, edges[0], edges[0][1:], edges[1], edges[1][1:])):
            own, a, b = p.encode(), joined[0][low_a:high_a], joined[1][low_b:high_b]
            if a != own or b != own:
                sound[i] = False
                found[i] = Aligned(0, 0, 0, "", (), (a, b))
        if not sound.all():
            for values in (sides, sizes):
                values[:] = [v[np.repeat(sound, n)] for v, n in zip(values, counts)]
            counts = [n[sound] for n in counts]
        if len(sides[0]):
            groups, pairs = coalesce(sides[0], sizes[0], counts[0], sides[1], sizes[1], counts[1], linked)
            for i, n_a, n_b, (n, text), linked_ids in zip(np.flatnonzero(sound).tolist(), counts[0].tolist(), counts[1].tolist(), groups, pairs, strict=True):
                found[i] = Aligned(n_a, n_b, n, text, linked_ids)
        return found

    def _left(self, spaced: list[str]) -> list[list[int]]:
        """The left side's ids of each part with its space; parts that a text could be cut into are encoded side by side."""
        found: list[list[int] | None] = [None] * len(spaced)
        fits = [i for i, p in enumerate(spaced) if p[-1] not in " ▁" and not p[1].isspace() and p[1] != "\u180e"]
        runs = [fits[i : i + TOGETHER] for i in range(0, len(fits), TOGETHER)]
        texts = ["".join([spaced[i] for i in run]) for run in runs]
        for run, e in zip(runs, self.a.encode_batch_fast(texts, add_special_tokens=False)):
            ids, upto = e.ids, np.cumsum([len(spaced[i].encode()) for i in run])
            ends = np.cumsum(self.size_a[ids])
            stops = np.searchsorted(ends, upto)
            if ends[-1] == upto[-1] and np.array_equal(ends[stops], upto):
                low = 0
                for i, high in zip(run, (stops + 1).tolist()):
                    found[i], low = ids[low:high], high
        alone = [i for i, one in enumerate(found) if one is None]
        for i, e in zip(alone, self.a.encode_batch_fast([spaced[i] for i in alone], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def of_texts(self, texts: list[str], linked: str) -> Iterator[list[Aligned]]:
        """The alignments of the parts of each text, in order."""
        cut = [_CUT.split(t) for t in texts]
        known, older = self.known[linked], self.older[linked]
        fresh, held, met = [], 0, {}

        def settle() -> None:
            new = self.align(fresh, linked)
            met.update(zip(fresh, new, strict=True))
            known.update((p, one) for p, one in zip(fresh, new) if len(p) <= KNOWN_CHARS)
            fresh.clear()

        for part in set(chain.from_iterable(cut)):
            if (one := known.get(part)) is not None:
                met[part] = one
            elif (one := older.get(part)) is not None:
                met[part] = known[part] = one
            else:
                fresh.append(part)
                held += len(part)
                if held >= BATCH_BYTES:
                    settle()
                    held = 0
        if fresh:
            settle()
        if len(known) > KNOWN_PARTS:  # what hasn't been met since the last change goes
            self.known[linked], self.older[linked] = {}, known
        for parts in cut:
            yield list(map(met.__getitem__, parts))


def _byte_of_sign() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones as themselves, the rest from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def coalesce(
    ids_a: np.ndarray, size_a: np.ndarray, per_a: np.ndarray, ids_b: np.ndarray, size_b: np.ndarray, per_b: np.ndarray, linked: str = "overlaps"
) -> tuple[list[tuple[int, str]], list[tuple[int, ...]]]:
    """Groups and linked pairs of many texts whose tokens follow each other: ids, byte lengths, and tokens per text, for either side.

    Returns per text (number of groups, `a1,a2|b1;...`) and the codes of its
    linked pairs: all that overlap, or with linked="ends" those of them that end together.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start = np.concatenate([end_a - size_a, end_b - size_b])
    end, ids = np.concatenate([end_a, end_b]), np.concatenate([ids_a, ids_b])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], start[order][1:] >= reached[:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    # where the running maximum stands as a group ends is a token's end on both sides, so texts, too, end with a group
    last = reached[np.append(np.flatnonzero(fresh)[1:] - 1, len(order) - 1)]
    text_end = np.add.reduceat(size_a, np.concatenate([[0], np.cumsum(per_a)[:-1]])).cumsum()
    group_of_text = np.searchsorted(last, text_end, "right")
    laid = np.lexsort((start, side, group))
    groups = _written(ids[laid], side[laid], group[laid], group_of_text)

    # overlaps expand within: the right side's tokens that end after a left one starts, up to the last that starts before it ends
    low, high = np.searchsorted(end_b, end_a - size_a, "right"), np.searchsorted(end_b - size_b, end_a, "left")
    many = high - low
    left = np.repeat(np.arange(len(ids_a)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    inside = group[left] == group[len(ids_a) + right]
    if linked == "ends":
        inside &= end_a[left] == end_b[right]
    left, right = left[inside], right[inside]
    code = ((ids_a[left] << SHIFT) | ids_b[right]).tolist()
    edges = np.searchsorted(left, np.concatenate([[0], np.cumsum(per_a)])).tolist()
    return groups, [tuple(code[a:b]) for a, b in zip(edges, edges[1:])]


def _written(ids: np.ndarray, side: np.ndarray, group: np.ndarray, group_of_text: np.ndarray) -> list[tuple[int, str]]:
    """Tokens laid out by group and side as text: `,` within a side, `|` before the right side, `;` between groups."""
    new_group = np.append(group[1:] != group[:-1], True)
    new_side = np.append(side[1:] != side[:-1], True)
    mark = np.where(new_group, MARKS.index(";"), np.where(new_side, MARKS.index("|"), MARKS.index(",")))
    words = list(map(_marked(1 << int(ids.max()).bit_length()).__getitem__, (ids * len(MARKS) + mark).tolist()))
    out, begun, first = [], 0, 0
    for until, stop in zip(group_of_text.tolist(), np.searchsorted(group, group_of_text, "left").tolist()):
        out.append((until - first, "".join(words[begun:stop])[:-1]))
        begun, first = stop, until
    return out


@lru_cache(maxsize=None)
def _marked(n: int) -> list[str]:
    """Each id below n, written with each mark behind it."""
    return [f"{i}{m}" for i in range(n) for m in MARKS]


def _pair_of(path_a: str, path_b: str) -> Pair:
    if _WORKER.get("paths") != (path_a, path_b):
        _WORKER.update(paths=(path_a, path_b), pair=Pair(path_a, path_b))
    return _WORKER["pair"]


def whole(text: str | None, parts: list[Aligned]) -> list[Aligned]:
    """The parts, or none of them where the text is empty or joins to other bytes than its own."""
    if not text:
        return []
    if any(map(attrgetter("wrong"), parts)):
        return []
    return parts


def align(docs: DataFrame, path_a: str, path_b: str, linked: str = "overlaps", text: str = "text") -> DataFrame:
    """Each row of `docs` with its alignment in place of the text; no shuffle.

    n_a, n_b: tokens of either side; n_groups; n_links; groups: the alignment
    as `a1,a2|b1;a3|b2,b3` in ids; pairs, times: the different linked pairs of
    the text (left id times 2^32 plus right id) and how often each is linked.
    linked: "overlaps" links all tokens that share a byte, "ends" those of them
    that end together. A null or empty text, and one whose tokens don't join to
    a space and the text, has no tokens: zeros, '' and empty lists. Special
    strings inside texts are plain text. Texts of any length are encoded whole;
    one without any space is a single part. Other columns pass through, except
    those with the names of the results, which are replaced. Repeated rows stay;
    an empty table gives an empty result.
    """
    if linked not in ("overlaps", "ends"):
        raise ValueError("linked is 'overlaps' or 'ends'")
    names = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    kept = [c for c in docs.columns if c not in (text, *names)]
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    longs = [T.StructField(c, T.LongType()) for c in names[:4]]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in names[5:]]
    schema = T.StructType([*slim.schema.fields[:-1], *longs, T.StructField("groups", T.StringType()), *lists])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair_of(path_a, path_b)
        for batch in batches:
            for low, high in _portions(batch.column(len(kept))):
                part = batch.slice(low, high - low)
                texts = part.column(len(kept)).to_pylist()
                rows = [_row(t, whole(t, found)) for t, found in zip(texts, pair.of_texts([t or "" for t in texts], linked), strict=True)]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[f.name for f in schema])

    return slim.mapInArrow(mapped, schema)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about BATCH_BYTES bytes of text."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    low = 0
    while low < len(upto):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BATCH_BYTES, "right")))
        yield low, high
        low = high


def _row(text: str | None, parts: list[Aligned]) -> tuple:
    n_a = n_b = n_groups = 0
    for p in parts:
        n_a += p.n_a
        n_b += p.n_b
        n_groups += p.n_groups
    codes = np.array(list(chain.from_iterable([p.pairs for p in parts])), np.int64)
    pairs, times = np.unique(codes, return_counts=True)
    return n_a, n_b, n_groups, len(codes), ";".join([p.groups for p in parts]), pairs, times


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair over all of `aligned`, and whether that is the highest of its right id."""
    entries = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).toDF("pair", "times")
    counted = stable(entries.groupBy("pair").agg(F.sum("times").alias("n")))
    right = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # a row per right id: bounded by the vocabulary, and measured all the same
    top = small_side(counted.groupBy(right.alias("__right")).agg(F.max("n").alias("__top")))
    return counted.join(top, right == F.col("__right")).select("pair", "n", (F.col("n") == F.col("__top")).alias("best"))


def with_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """`aligned` (a column __row that names each row, pairs, times, and any others) with n_best and count_sum.

    n_best: links whose pair is the commonest of its right id, ties included;
    count_sum: the pair's count, summed over links. Both are 0 without links.
    """
    counts = stable(pair_counts(aligned))
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["count"] for r in counts.groupBy(power.alias("p")).count().collect()}  # at most 63 rows
    least, held = 64, 0
    while least and held + sizes.get(least - 1, 0) <= hot_pairs:
        least, held = least - 1, held + sizes.get(least - 1, 0)
    hot, rest = F.broadcast(counts.where(power >= least)), counts.where(power < least)
    entries = aligned.select("__row", F.inline(F.arrays_zip("pairs", "times"))).toDF("__row", "pair", "times")
    shares = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = entries.join(hot, "pair").groupBy("__row").agg(*shares)
    if held < sum(sizes.values()):
        rare = entries.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair").groupBy("__row").agg(*shares)
        found = found.unionByName(rare).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = found.withColumnRenamed("__row", "__at")
    whole_rows = aligned.drop("n_best", "count_sum").join(found, F.col("__row") == F.col("__at"), "left").drop("__at")
    return whole_rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def alignment_summary(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts of tokens, groups and links, n_best, count_sum, and the digest of the groups.

    Tokens that end together are linked. groups_sha256 is '' where there are no
    tokens. Other columns of `docs` are not carried.
    """
    rows = align(numbered(docs.select("doc_id", "text")), path_a, path_b, "ends")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    # the digest replaces the alignment before anything is written
    slim = stable(rows.withColumn("groups_sha256", digest).drop("groups"))
    return with_counts(slim).drop("__row", "pairs", "times")
