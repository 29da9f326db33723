"""Recursive and fixed-window character chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators from the coarsest to the finest, and the sizes of chunks and overlaps.
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
GATE_CHUNK_SIZE, GATE_CHUNK_OVERLAP = 500, 50


def _cut(text: str, separator: str) -> list[str]:
    """Pieces at the separator, which stays at the head of the piece it opens."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [piece for piece in [head, *(separator + r for r in rest)] if piece]


def _packed(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Fill chunks with whole pieces; the next chunk starts with up to ``overlap`` old characters."""
    held: deque[str] = deque()
    length = 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def _chunks(text: str, size: int, overlap: int, separators: Sequence[str]) -> Iterator[str]:
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[level + 1 :] if separators[level] else ()
    small: list[str] = []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        yield from _packed(small, size, overlap)
        small = []
        if finer:
            yield from _chunks(piece, size, overlap, finer)
        else:
            yield piece
    yield from _packed(small, size, overlap)


def split_text(
    text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks of one text, stripped, empty ones left out."""
    if overlap > size:
        raise ValueError("overlap exceeds the chunk size")
    stripped = (chunk.strip() for chunk in _chunks(text or "", size, overlap, tuple(separators)))
    return [chunk for chunk in stripped if chunk]


def recursive_chunks(
    documents: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """One row per chunk with ``chunk_no`` from 0; all other columns are carried along.

    Narrow: every task splits its own documents, nothing is shuffled.
    """
    fields = [*documents.schema.fields, T.StructField("chunk_no", T.IntegerType())]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunked = batch.assign(**{text: [split_text(t, size, overlap, separators) for t in batch[text]]})
            numbered = chunked.assign(chunk_no=[list(range(len(c))) for c in chunked[text]])
            rows = numbered.explode([text, "chunk_no"]).dropna(subset=["chunk_no"])
            yield rows.astype({"chunk_no": "int32"})

    return documents.mapInPandas(split, T.StructType(fields))


def window_chunks(
    documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of ``size`` characters that step by ``size - overlap``; native expressions only."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap
    last = F.greatest(F.length(text) - F.lit(overlap) - 1, F.lit(0))
    rest = [c for c in documents.columns if c != text]
    starts = documents.filter(F.length(text) > 0).select(
        *rest, text, F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start")
    )
    return starts.select(
        *rest,
        (F.col("start") / step).cast("int").alias("chunk_no"),
        "start",
        F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias(text),
    )
