"""Files that were not seen before: a durable memory with Bloom filters that forgets closed periods."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpointed, child_folders, claim, file_names, make_folder, remove_folder

SHARDS = 64
HASHES = 7
# Bits per name, rounded up to a power of two in all: one name in a hundred or fewer is looked up in vain.
BITS = 10

_FILTERS = "shard int, bits binary, batch int, period long"
_SEEN = "filename string, ts timestamp, batch int, period long"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of every hash, one row each."""
    h = hashes.astype(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (first[:, None] + np.arange(HASHES, dtype=np.uint64)[None] * step[:, None]) % np.uint64(bits)


def bloom_filter(hashes: np.ndarray) -> bytes:
    bits = 1 << max(6, int(BITS * len(hashes) - 1).bit_length())
    held = np.zeros(bits, bool)
    held[_places(hashes, bits).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """False for every hash that is surely not in the filter."""
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_places(hashes, len(held))].all(axis=1)


def _checked(names: DataFrame, filters: DataFrame) -> DataFrame:
    """Names with ``maybe``: whether a filter of their period and shard may hold them."""

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        hashes, periods = asked.column("hash").to_numpy(), asked.column("period").to_numpy()
        maybe = np.zeros(len(hashes), bool)
        for period, bits in zip(held.column("period").to_pylist(), held.column("bits").to_pylist()):
            rows = np.flatnonzero(periods == period)
            if len(rows):
                maybe[rows] |= may_hold(bits, hashes[rows])
        return asked.append_column("maybe", pa.array(maybe)).select(["filename", "ts", "period", "hash", "shard", "maybe"])

    schema = "filename string, ts timestamp, period long, hash long, shard int, maybe boolean"
    return names.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(check, schema)


def _filters_of(fresh: DataFrame) -> DataFrame:
    """A filter for the names of every shard and period."""

    def build(rows: pa.Table) -> pa.Table:
        bits = bloom_filter(rows.column("hash").to_numpy())
        return pa.table({"shard": rows.column("shard")[:1], "period": rows.column("period")[:1], "bits": pa.array([bits], pa.binary())})

    return fresh.select("shard", "period", "hash").groupBy("shard", "period").applyInArrow(build, "shard int, period long, bits binary")


def _finished(spark: SparkSession, root: str, before: int) -> tuple[list[int], int | None]:
    """Batches that were finished before this one, and the newest event time among them in microseconds."""
    marks = [tuple(map(int, n.split("."))) for n in file_names(spark, f"{root}/marks")]
    marks = [m for m in marks if m[0] < before]
    return [b for b, _ in marks], max((t for _, t in marks), default=None)


def _table(spark: SparkSession, path: str, schema: str, batches: list[int]) -> DataFrame:
    make_folder(spark, path)
    return spark.read.schema(schema).parquet(path).filter(F.col("batch").isin(batches))


def take_batch(batch: DataFrame, batch_id: int, root: str, period: timedelta, delay: timedelta) -> None:
    """Store the rows of one micro-batch whose file name is new in its period.

    ``batch`` holds ``filename`` and ``ts``. Names that no filter may hold are new
    without a look at the stored names; only the others are compared with those of
    the same period. Rows of a period that was closed before this batch came (by the
    newest time of earlier batches less ``delay``) are too late and dropped. The filters of
    closed periods are removed, and their names never read again, so the memory is that of the
    open periods. A batch that is repeated replaces its own files.
    """
    spark = batch.sparkSession
    seconds = int(period.total_seconds())
    done, newest = _finished(spark, root, batch_id)
    start = F.floor(F.unix_seconds("ts") / seconds) * seconds
    rows = batch.select("filename", F.col("ts").cast("timestamp").alias("ts")).filter("filename is not null and ts is not null")
    names = rows.withColumn("period", start.cast("long")).groupBy("filename", "period").agg(F.min("ts").alias("ts"))
    names = names.withColumn("hash", F.xxhash64("filename")).withColumn("shard", F.pmod("hash", F.lit(SHARDS)).cast("int"))
    own_newest = rows.agg(F.max(F.unix_micros("ts")).alias("t")).first()["t"]
    if newest is not None:
        closed = (newest - delay // timedelta(microseconds=1)) // 1_000_000
        names = names.filter(F.col("period") + seconds > closed)
    filters = _table(spark, f"{root}/filters", _FILTERS, done).select("shard", "period", "bits")
    checked = checkpointed(_checked(names, filters))
    seen = _table(spark, f"{root}/seen", _SEEN, done).select("filename", "period")
    known = checked.filter("maybe").join(seen, ["filename", "period"], "left_anti")
    fresh = checked.filter("not maybe").unionByName(known.select(*checked.columns))
    fresh.select("filename", "ts", "period").write.mode("overwrite").partitionBy("period").parquet(f"{root}/seen/batch={batch_id}")
    written = _table(spark, f"{root}/seen", _SEEN, [batch_id]).withColumn("hash", F.xxhash64("filename"))
    written = written.withColumn("shard", F.pmod("hash", F.lit(SHARDS)).cast("int"))
    _filters_of(written).write.mode("overwrite").partitionBy("period").parquet(f"{root}/filters/batch={batch_id}")
    latest = max(t for t in (newest, own_newest, 0) if t is not None)
    claim(spark, f"{root}/marks/{batch_id:012d}.{latest}")
    closed = (latest - delay // timedelta(microseconds=1)) // 1_000_000
    for held in child_folders(spark, f"{root}/filters"):
        for part in child_folders(spark, f"{root}/filters/{held}"):
            if part.startswith("period=") and int(part.removeprefix("period=")) + seconds <= closed:
                remove_folder(spark, f"{root}/filters/{held}/{part}")


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """``filename``, ``ts``, ``batch`` and ``period`` (its start in seconds) of all files that were new."""
    marks = [int(n.split(".")[0]) for n in file_names(spark, f"{root}/marks")]
    return _table(spark, f"{root}/seen", _SEEN, marks)


def stream_new_files(
    files: DataFrame, root: str, checkpoint: str, period: timedelta = timedelta(days=30), delay: timedelta = timedelta(days=1)
) -> StreamingQuery:
    """Keep the first row of every file name in its period, over any number of micro-batches and restarts."""
    return (
        files.writeStream.foreachBatch(lambda batch, batch_id: take_batch(batch, batch_id, root, period, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
