"""Ranked lexical search, term at a time with a limited number of accumulators."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scaling import keep_top, running_start
from ..session import work_folder

K = 10
# Items are ranked in blocks of so many terms (plus the last item's), each block in one pass over the index.
BLOCK_TERMS = 200_000
# Documents and postings that one task holds at a time.
BLOCK_DOCS = 20_000
BLOCK_POSTINGS = 2_000_000

# Fixed values of the score: the parts of a document's m, and the factors of a term's share.
LENGTH_BASE, LENGTH_SHARE = 25, 75
TF_SCALE, TF_FACTOR, LENGTH_FACTOR, WEIGHT_SCALE = 1_000_000_000, 1000, 8, 1000

# ASCII digits and letters make terms, so do all bytes of other characters; A-Z are lower-cased.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, in order; a null text has none."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def term_weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """A bounded number of items: their vocabulary and, per item, its term numbers with repeats."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, dict[int, int]]] = []
        for number, text in items:
            found = Counter(terms(text))
            self.items.append((number, {self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in found.items()}))


def index_documents(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: id, ``n`` of its terms, and numbers and counts of those in the block's vocabulary."""
    vocabulary = block.vocabulary

    def encode(batches):
        known = vocabulary.get
        for batch in batches:
            rows, sizes, numbers, counts = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                tally = Counter(map(known, found))
                tally.pop(None, None)
                rows.append(row)
                sizes.append(len(found))
                numbers.append(list(tally))
                counts.append(list(tally.values()))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(sizes, pa.int64()),
                pa.array(numbers, pa.list_(pa.int32())),
                pa.array(counts, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "terms", "counts"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(encode, f"_id {kind}, n long, terms array<int>, counts array<int>")


class Postings:
    """Inverted lists of one block of documents, kept in memory while its items are ranked."""

    def __init__(self, ids: pa.Array, n: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, length: int):
        self.ids, self.size = ids, len(ids)
        m = LENGTH_BASE + LENGTH_SHARE * n * documents // length
        doc, tf = np.repeat(np.arange(self.size), held), tf.astype(np.int64)
        share = TF_SCALE * tf // (TF_FACTOR * tf + LENGTH_FACTOR * m[doc])
        order = np.argsort(term, kind="stable")
        term, self.docs, self.shares = term[order], doc[order], share[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(term)]
        best = np.maximum.reduceat(self.shares, starts) if len(term) else np.empty(0, np.int64)
        self.lists = {int(term[s]): (int(s), int(e), int(b)) for s, e, b in zip(starts, ends, best)}
        by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        self.id_rank = np.empty(self.size, np.int64)
        self.id_rank[by_id] = np.arange(self.size)

    def rank(self, wanted: dict[int, int], weights: list[int], holding: list[int], floor: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The block's best ``k`` (score, document) of an item, and how many accumulators it made.

        Terms come rarest first. While a document that no earlier term has reached
        could still get to ``floor`` or to the k-th largest partial score with
        all of the terms that are left, terms make accumulators; after that they only
        add to those that exist, each to its exact score. ``floor`` is a score that
        ``k`` documents elsewhere have.
        """
        plan = []
        for t in sorted(wanted, key=lambda t: (holding[t], t)):
            if t in self.lists and weights[t] > 0:
                start, end, best = self.lists[t]
                plan.append((start, end, weights[t] * wanted[t], weights[t] * wanted[t] * best))
        left = sum(bound for *_, bound in plan)
        scores = np.zeros(self.size, np.int64)
        creating, least = True, floor
        for start, end, factor, bound in plan:
            if creating and left < least:
                creating = False
                live = scores > 0
            docs, gains = self.docs[start:end], factor * self.shares[start:end]
            if creating:
                scores[docs] += gains
                partial = scores[scores > 0]
                if len(partial) >= k:
                    least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            else:
                old = live[docs]
                scores[docs[old]] += gains[old]
            left -= bound
        reached = np.flatnonzero(scores)
        made = len(reached)
        reached = reached[scores[reached] >= floor]
        if len(reached) > k:
            values = scores[reached]
            reached = reached[values >= np.partition(values, len(values) - k)[len(values) - k]]
        best = reached[np.lexsort((self.id_rank[reached], -scores[reached]))][:k]
        return [(int(scores[d]), int(d)) for d in best], made


def _order(row: tuple):
    score, doc = row
    return -score, doc is None, doc if doc is not None else 0


def score_block(index: DataFrame, block: Block, weights: list[int], holding: list[int], documents: int, length: int, k: int) -> DataFrame:
    """The best ``k`` documents of each of a block's items within every task: ``_item``, ``_id``, ``score``."""
    items = block.items
    id_type = index.schema["_id"].dataType

    def rank(batches):
        best: dict[int, list] = {number: [] for number, _ in items}
        held, docs, postings = [], 0, 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, lists, counts = (table.column(c).combine_chunks() for c in ("_id", "terms", "counts"))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            n, terms_of, counts_of = table.column("n").to_numpy(), pc.list_flatten(lists).to_numpy(), pc.list_flatten(counts).to_numpy()
            lists_of = Postings(ids, n, sizes, terms_of, counts_of, documents, length)
            for number, wanted in items:
                so_far = best[number]
                floor = so_far[k - 1][0] if len(so_far) == k else 1
                found, _ = lists_of.rank(wanted, weights, holding, floor, k)
                if found:
                    best[number] = sorted([*so_far, *((s, ids[d].as_py()) for s, d in found)], key=_order)[:k]

        for batch in batches:
            # A slice never holds more than the bound, however many rows a batch has.
            for at in range(0, batch.num_rows, BLOCK_DOCS // 4):
                piece = batch.slice(at, BLOCK_DOCS // 4)
                held.append(piece)
                docs += piece.num_rows
                postings += pc.sum(pc.list_value_length(piece.column("terms"))).as_py() or 0
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    flush()
                    held, docs, postings = [], 0, 0
        if docs:
            flush()
        rows = [(number, doc, score) for number, found in best.items() for score, doc in found]
        if rows:
            numbers, found, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, arrow_id), pa.array(scores, pa.int64())], ["_item", "_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    return index.mapInArrow(rank, f"_item long, _id {id_type.simpleString()}, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of every item.

    Items go through in blocks of ``block_terms`` terms, of which the driver and the
    tasks hold one at a time. For each block the documents are read once and
    written as a narrow index: their number of terms, and how often each holds
    the block's terms. The index gives the corpus counts (documents, terms, and
    documents per term); then each task inverts it in blocks of ``BLOCK_DOCS``
    documents and adds up scores term at a time, rarest first. Accumulators are
    made until the bounds of the terms left cannot reach the k-th partial score, and
    those made are then carried on exactly, so the ranking is exact. A task keeps
    ``k`` rows per item, which one window per item merges.

    Equal scores are ordered by ascending id, null ids last. Null and empty texts
    have no terms and are not counted; an item without terms, or whose terms no
    document holds, gives no rows. Every row of ``items`` is an item and every row of
    ``docs`` a document, so repeated rows are ranked and listed each by itself.
    An empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "lexical")
    kind = items.schema[item_id_col].dataType.simpleString()
    doc_kind = docs.schema[id_col].dataType.simpleString()
    wanted = items.select(F.col(f"`{item_id_col}`").alias("_name"), F.col(f"`{item_text_col}`").cast("string").alias("_text"))
    # Words parted at white space are no more than a guide to how many terms an item has.
    wanted = wanted.withColumn("_size", F.coalesce(F.size(F.split("_text", r"\W+")), F.lit(0)).cast("long"))
    wanted.withColumn("_item", F.monotonically_increasing_id()).write.parquet(f"{folder}/items")
    wanted = spark.read.parquet(f"{folder}/items")
    total = wanted.agg(F.sum("_size").alias("n")).first()["n"] or 0
    blocks = 1
    if total > block_terms:
        starts = running_start(wanted.select("_item", "_size"), "_item", "_size")
        starts = starts.select("_item", F.floor(F.col("start") / block_terms).cast("int").alias("_block"))
        wanted.drop("_size").join(starts, "_item").write.partitionBy("_block").parquet(f"{folder}/blocks")
        blocks = total // block_terms + 1
        wanted = spark.read.parquet(f"{folder}/blocks")
    else:
        wanted = wanted.withColumn("_block", F.lit(0))

    found = None
    for number in range(blocks):
        block = Block([(r["_item"], r["_text"]) for r in wanted.filter(F.col("_block") == number).select("_item", "_text").toLocalIterator()])
        if not block.vocabulary:
            continue
        index_documents(docs, block, id_col, text_col).write.parquet(f"{folder}/index-{number}")
        index = spark.read.parquet(f"{folder}/index-{number}")
        sums = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        if not sums["documents"]:
            break
        holding = [0] * len(block.vocabulary)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # the block's terms
            holding[row["term"]] = row["count"]
        weights = [term_weight(sums["documents"], n) for n in holding]
        best = score_block(index, block, weights, holding, sums["documents"], sums["length"], k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last()]
    top = keep_top(found, ["_item"], order, k, spread=["_id"])
    names = wanted.select("_item", "_name")
    return top.join(names, "_item").select(
        F.col("_name").alias("item_id"), F.col("rk").cast("int").alias("rank"), F.col("_id").alias("doc_id"), "score"
    )
