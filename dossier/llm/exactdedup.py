"""Exact duplicates: frequent digests apart, all others by an ordinary shuffle. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_folder
from .naming import unused

# A digest of more than this share of all rows is frequent; at most 1 / SHARE digests are.
SHARE = 0.001
# Counters of a summary. A digest above SHARE of the rows keeps one: the error of this many is below SHARE / 2.
COUNTERS = 8192
MOST_CANDIDATES = 2000
# Summaries are merged in so many tasks before the last one merges theirs.
MERGERS = 64


def text_digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8; null is the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2((normalise(text) if normalise else text).cast("binary"), 256)


def frequent_digests(rows: DataFrame, column: str = "_digest") -> DataFrame:
    """Candidates for the digests of more than ``SHARE`` of all rows, none of these left out.

    A Misra-Gries summary: a bounded number of counters per task, all lowered
    together when none is free. Each task fills one, ``MERGERS`` tasks merge
    those, and one task merges the ``MERGERS`` that are left, so that its
    work does not grow with the number of input partitions. At most
    ``MOST_CANDIDATES`` rows; counts are estimates and decide nothing.
    """
    summary = F.expr(f"approx_top_k_accumulate(`{column}`, {COUNTERS})")
    merged = F.expr(f"approx_top_k_combine(_summary, {COUNTERS})")
    near = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger")).agg(summary.alias("_summary"))
    # Grouped by a constant: a table without rows has no summaries to merge.
    best = near.withColumn("_all", F.lit(0)).groupBy("_all").agg(merged.alias("_summary")).select(F.expr(f"approx_top_k_estimate(_summary, {MOST_CANDIDATES})").alias("_best"))
    return best.select(F.explode("_best.item").alias(column))


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest: size, the largest id, the first row that has it, and how many rows have it."""
    best = F.max(F.struct("_id", (-F.col("_row")).alias("_at")))
    by_id = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_size"), best.alias("_best"))
    return by_id.select("_digest", "_size", F.col("_best._id").alias("_keep"), (-F.col("_best._at")).alias("_first"))


class Copies:
    """Rows, groups and winners of a table; what both results below are made of."""

    def __init__(self, docs: DataFrame, id_col: str, digest: Column):
        spark = docs.sparkSession
        folder = work_folder(spark, "digests")
        narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), digest.alias("_digest"))
        # Written once: texts are read and hashed once, and row numbers stay as they are.
        narrow.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
        self.rows = spark.read.parquet(folder)
        least = max(2.0, SHARE * self.rows.count())
        candidates = F.broadcast(frequent_digests(self.rows))  # at most MOST_CANDIDATES rows
        counted = _groups(self.rows.join(candidates, "_digest", "left_semi")).filter(F.col("_size") >= least)
        # Verified by exact counts; at most 1 / SHARE rows. Written, so that every reader sees the same ones.
        counted.write.parquet(f"{folder}-winners")
        self.winners = F.broadcast(spark.read.parquet(f"{folder}-winners"))
        self.light = self.rows.join(self.winners, "_digest", "left_anti")
        self.light_groups = _groups(self.light)


def label_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row, dropped ones too.

    Of rows with equal texts (equal SHA-256) the one with the largest id stays. A
    summary finds the digests of more than ``SHARE`` of the rows; their exact
    sizes and winners are counted and broadcast (at most 1 / ``SHARE`` rows), and
    their rows are decided where they are read, without a shuffle. All other
    digests, whose groups are smaller than that share, are shuffled: counted
    with partial sums, and joined back. Only ids and digests move, never texts.

    Null text counts as empty. A null id is smaller than any other; of rows with
    the same id and text exactly one stays, whichever. An empty table gives
    no rows. Other columns, whatever their names, are not read.
    """
    copies = Copies(docs, id_col, text_digest(F.col(f"`{text_col}`"), normalise))
    heavy = copies.rows.join(copies.winners, "_digest")
    light = copies.light.join(copies.light_groups, "_digest")
    return heavy.unionByName(light).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_first")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The rows that :func:`label_copies` keeps, with all their columns.

    Copies of a frequent text go where they are read: only its winner's rows pass the
    broadcast table. The other texts are shuffled once by digest and id. Of
    rows with the same id and the same text one is kept, whichever. Null texts are
    empty, null ids smallest, an empty table stays empty, and columns of any name
    pass through.
    """
    digest, keep, mark = unused(docs.columns, "_digest", "_keep", "_tied")
    sha = text_digest(F.col(f"`{text_col}`"), normalise)
    copies = Copies(docs, id_col, sha)
    # How many rows share the winner's id and text; nearly always one.
    won = copies.rows.join(copies.winners, "_digest").filter(F.col("_id").eqNullSafe(F.col("_keep")))
    heavy_ids = F.broadcast(won.groupBy("_digest", "_keep").agg(F.count(F.lit(1)).alias("_n")))
    same = copies.light.groupBy("_digest", "_id").agg(F.count(F.lit(1)).alias("_n"))
    light_ids = copies.light_groups.select("_digest", "_keep").join(
        same.withColumnRenamed("_digest", "_of"), (F.col("_digest") == F.col("_of")) & F.col("_keep").eqNullSafe(F.col("_id"))
    ).select("_digest", "_keep", "_n")

    def renamed(ids: DataFrame) -> DataFrame:
        return ids.select(F.col("_digest").alias(digest), F.col("_keep").alias(keep), (F.col("_n") > 1).alias(mark))

    marked = docs.withColumn(digest, sha)
    is_winner = F.col(f"`{id_col}`").eqNullSafe(F.col(keep))
    heavy_only = F.broadcast(copies.winners.select(F.col("_digest").alias(digest)))
    heavy = marked.join(F.broadcast(renamed(heavy_ids)), digest).filter(is_winner)
    light = marked.join(heavy_only, digest, "left_anti").join(renamed(light_ids), digest).filter(is_winner)
    found = heavy.unionByName(light)
    single = found.filter(~F.col(mark))
    tied = found.filter(F.col(mark)).dropDuplicates([digest])
    return single.unionByName(tied).select(*[F.col(f"`{c}`") for c in docs.columns])
