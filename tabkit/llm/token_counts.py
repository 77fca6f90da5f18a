"""Token counts by batch encoding: lengths leave the Arrow functions, token ids never do.

A text is cut only where that cannot change the count: at a space that follows
neither a space nor the space mark itself. No piece of the vocabulary holds a space mark after another
character (checked when the model is loaded), so no merge ever crosses such a
cut, and the mark the library puts before the next part stands for the space
removed. Parts repeat heavily, so each worker keeps the lengths of those it has
met, in a table of bounded size; the rest is encoded in batches of about
`batch_bytes` bytes, whatever the number of texts in them. A text of any length
thus needs its own bytes and one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BATCH_BYTES = 1 << 20
#: Lengths kept per worker, and the longest part worth keeping (about 100 MB in all at most).
KNOWN_PARTS, KNOWN_CHARS = 400_000, 64

#: The library takes its own mark in a text for a space.
_CUT = re.compile(r"(?<=[^ ▁]) ")
_WORKER: dict = {}


def _load(path: str):
    """The encoder and its table of known lengths, once per worker."""
    if _WORKER.get("path") != path:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (encoder.id_to_piece(i) for i in range(encoder.vocab_size()))
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("this vocabulary joins words, so its texts can't be cut at spaces")
        _WORKER.update(path=path, encoder=encoder, known={})
    return _WORKER["encoder"], _WORKER["known"]


def count_batch(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """Tokens of each text, as the library counts them on the whole text."""
    encoder, known = _load(path)
    if len(known) > KNOWN_PARTS:
        known.clear()
    totals = [0] * len(texts)
    waiting: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        distinct = list(dict.fromkeys(waiting))
        lengths = dict(zip(distinct, map(len, encoder.encode(distinct, num_threads=1)), strict=True))
        for part, owner in zip(waiting, owners, strict=True):
            totals[owner] += lengths[part]
        known.update((p, n) for p, n in lengths.items() if len(p) <= KNOWN_CHARS)
        waiting.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        first, *rest = _CUT.split(text) if "  " in text or text[:1] == " " or "▁" in text else text.split(" ")
        total = 0
        for part in rest:
            if not part:
                total += 1  # a last single space is one mark of its own
            elif (n := known.get(part)) is not None:
                total += n
            else:
                waiting.append(part)
                owners.append(i)
                held += len(part)
                if held >= batch_bytes:
                    flush()
        if first:
            waiting.append(first)
            owners.append(i)
            held += len(first)
        totals[i] += total
        if held >= batch_bytes:
            flush()
    if waiting:
        flush()
    return totals


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Each row with n_bytes, n_tokens and over_limit in place of its text; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay. Other
    columns pass through, except those with the names of the three results,
    which are replaced. An empty table gives an empty result.
    """
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in (text, *names)]
    # under a name of its own, so that no column of the caller's can clash
    slim = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*(f for f in slim.schema if f.name != "__text"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            counts = pa.array(count_batch(texts.to_pylist(), path, batch_bytes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pc.cast(pc.binary_length(texts), pa.int64()), counts, pc.greater(counts, limit)],
                names=[*batch.schema.names[:-1], *names],
            )

    return slim.mapInArrow(lengths, schema)

