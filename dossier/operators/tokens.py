"""Vocabulary, padded token rows, masks and fixed blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_tokens
from .scaling import BROADCAST_ROWS, RANGE_ROWS, global_position, running_start, small_rows

MAX_LENGTH = 128
BLOCK_SIZE = 128
IGNORED_LABEL = -100
BLOCK_BYTES = 16 * 1024 * 1024
PAD_ID, UNKNOWN_ID, FIRST_TERM_ID = 0, 1, 2


def build_vocabulary(texts: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """``(term, id)`` of all terms by frequency, or of the ``size`` most frequent; id 0 pads, id 1 is unknown.

    Terms are counted per task before they move. The order of the terms is that
    of a sort across the cluster, so no task sees the whole vocabulary.
    """
    counts = texts.select(F.explode(word_tokens(F.col(text))).alias("term")).groupBy("term").count()
    placed = global_position(counts, [F.col("count").desc(), F.col("term")])
    if size is not None:
        placed = placed.filter(F.col("position") <= size)
    return placed.select("term", (F.col("position") + (FIRST_TERM_ID - 1)).cast("int").alias("id"))


def _token_lists(texts: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    tokens = F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>"))
    return texts.select(F.col(doc_id), *more, tokens.alias("terms"))


def _coded(lists: pa.ListArray, terms: pa.Array, ids: pa.Array) -> pa.ListArray:
    """Term lists as id lists; all terms of a batch are looked up at once."""
    flat = pc.list_flatten(lists)
    found = pc.take(ids, pc.index_in(flat, value_set=terms)).fill_null(UNKNOWN_ID)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), found.cast(pa.int32()))


def encode(
    texts: DataFrame,
    vocabulary: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary_size: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, ids)`` for every text, an empty array for a text without terms.

    ``vocabulary_size`` is a known bound on the vocabulary; without it the
    vocabulary is measured. One that fits goes to every task, and texts are
    coded where they are read. A larger one stays a table: texts are dealt into
    blocks of about ``block_bytes``, the distinct terms of each block are looked up by
    a join, and each block is coded with its own terms. Either way a text stays
    whole; no row per token is made but for the distinct terms of a block.
    """
    known = vocabulary.select("term", "id")
    schema = f"{texts.select(doc_id).schema[0].name} {texts.schema[doc_id].dataType.simpleString()}, ids array<int>"
    fits = vocabulary_size <= BROADCAST_ROWS if vocabulary_size is not None else small_rows(known) is not None
    if fits:
        table = known.toArrow()  # measured or bounded above
        terms, ids = table.column("term").combine_chunks(), table.column("id").combine_chunks()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), _coded(batch.column(1), terms, ids)], [doc_id, "ids"])

        return _token_lists(texts, doc_id, text).mapInArrow(run, schema)

    size = texts.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = int(size // block_bytes) + 1
    placed = texts.withColumn("_block", F.pmod(F.xxhash64(doc_id), F.lit(blocks)))
    lists = _token_lists(placed, doc_id, text, "_block")
    # Terms are made distinct by block before they move.
    distinct = lists.select(F.col("_block").alias("_of"), F.explode(F.array_distinct("terms")).alias("term")).distinct()
    # A term has one row a block, so no key is hot and the vocabulary moves once.
    looked_up = distinct.join(known, "term")

    def code(texts_of: pa.Table, terms_of: pa.Table) -> pa.Table:
        terms, ids = terms_of.column("term").combine_chunks(), terms_of.column("id").combine_chunks()
        lists_of = texts_of.column("terms").combine_chunks()
        return pa.table([texts_of.column(doc_id), _coded(lists_of, terms, ids)], [doc_id, "ids"])

    return lists.groupBy("_block").cogroup(looked_up.groupBy("_of")).applyInArrow(code, schema)


def encode_with(
    texts: DataFrame, tokenize: Callable[[list[str]], Sequence[Sequence[int]]], text: str = "text", out: str = "ids"
) -> DataFrame:
    """Token ids from a caller's tokenizer, called once per Arrow batch."""
    fields = [*texts.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [list(ids) for ids in tokenize(batch[text].tolist())]})

    return texts.mapInPandas(run, T.StructType(fields))


def truncated(ids: Column, length: int = MAX_LENGTH) -> Column:
    return F.slice(ids, 1, length)


def padded(ids: Column, length: int = MAX_LENGTH, pad: int = PAD_ID) -> Column:
    """Cut to ``length`` and fill up on the right."""
    cut = truncated(ids, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def attention_mask(ids: Column, length: int = MAX_LENGTH) -> Column:
    used = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(length) - used))


def masked_labels(input_ids: Column, pad: int = PAD_ID) -> Column:
    """Labels with every pad id ignored, a genuine token of that id included."""
    return F.transform(input_ids, lambda x: F.when(x == pad, F.lit(IGNORED_LABEL)).otherwise(x))


def training_rows(
    encoded: DataFrame, ids: str = "ids", length: int = MAX_LENGTH, pad: int = PAD_ID, causal_labels: bool = True
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of equal length, with causal labels on request."""
    rows = encoded.withColumn("input_ids", padded(F.col(ids), length, pad)).withColumn(
        "attention_mask", attention_mask(F.col(ids), length)
    )
    if causal_labels:
        rows = rows.withColumn("labels", masked_labels(F.col("input_ids"), pad))
    return rows.drop(ids)


def token_count(ids: Column, length: int = MAX_LENGTH) -> Column:
    return F.least(F.size(ids), F.lit(length))


def token_stats(encoded: DataFrame, ids: str = "ids", length: int = MAX_LENGTH) -> DataFrame:
    """Largest and mean token count after truncation; null for an empty corpus."""
    count = token_count(F.col(ids), length)
    return encoded.agg(F.max(count).alias("max_tokens"), F.avg(count).alias("avg_tokens"))


def packed_blocks(
    encoded: DataFrame,
    order: str = "doc_id",
    ids: str = "ids",
    block_size: int = BLOCK_SIZE,
    rows_per_range: int = RANGE_ROWS,
    order_values: DataFrame | None = None,
) -> DataFrame:
    """The whole corpus as one token run, cut into full blocks ``(block, input_ids)``.

    Every document learns its offset from a two-pass running sum, cuts its own
    tokens at block borders, and the pieces of a block (never more than
    ``block_size`` tokens) are put together. The last, partial block is dropped.
    ``order_values`` is any cheap table with the same order column, say the
    texts before encoding; with the token count as ``n`` the corpus is encoded
    only once.
    """
    sized = encoded.select(order, ids, F.size(ids).cast("long").alias("n")).filter("n > 0")
    placed = running_start(sized, order, "n", "start", rows_per_range, order_values=order_values)
    size = F.lit(block_size).cast("long")
    first = F.floor(F.col("start") / size)
    last = F.floor((F.col("start") + F.col("n") - 1) / size)
    pieces = placed.select(ids, "start", "n", F.explode(F.sequence(first, last)).alias("block"))
    from_token = F.greatest(F.col("block") * size - F.col("start"), F.lit(0).cast("long"))
    to_token = F.least((F.col("block") + 1) * size - F.col("start"), F.col("n"))
    pieces = pieces.select(
        "block",
        (F.col("start") + from_token).alias("at"),
        F.slice(F.col(ids), (from_token + 1).cast("int"), (to_token - from_token).cast("int")).alias("part"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "part")))
    joined = pieces.groupBy("block").agg(F.flatten(F.transform(ordered, lambda p: p["part"])).alias("input_ids"))
    return joined.filter(F.size("input_ids") == block_size)
