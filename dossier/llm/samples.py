"""Training rows: which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
PIECE_BITS = 16


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    """False for a null id, which no label can name."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def sampled(labelled: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows (id, label) of each label, by the order of a hash of the id.

    Rows of fold 0, null ids and null labels are never taken. Rows are counted
    by label and the first bits of the hash; only the first pieces that make up
    the number go on to be ordered, so a common label is not gathered anywhere.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (fold("_id") != 0)).distinct()
    rows = rows.withColumn("_hash", F.xxhash64("_id")).withColumn("_piece", F.shiftrightunsigned("_hash", 64 - PIECE_BITS))
    sizes = rows.groupBy("_label", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_label").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") < per_label)
    # At most ``per_label`` pieces of each label.
    few = rows.join(F.broadcast(first), ["_label", "_piece"])
    inside = F.col("_before") + F.col("_n") <= per_label
    # Only the piece that straddles the number is put in order.
    order = Window.partitionBy("_label").orderBy("_hash", "_id")
    edge = few.filter(~inside).withColumn("_rank", F.row_number().over(order)).filter(F.col("_before") + F.col("_rank") <= per_label)
    return few.filter(inside).select("_id", "_label").union(edge.select("_id", "_label"))
