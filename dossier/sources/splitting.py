"""JSON arrays larger than a task: byte ranges, their states, and the records that begin in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import json_texts

RANGE_BYTES = 32 * 1024 * 1024
MORE_BYTES = 64 * 1024

# Where a range of bytes may begin: between values, in a string, in a string after a backslash.
OUTSIDE, INSIDE, ESCAPED = range(3)


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of the brackets and commas that are no part of a string, and the state at the end."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), b, state
    at = np.arange(len(b))
    slash = b == ord("\\")
    # Backslashes right before each byte; those of the range before count as one more if the last is active.
    plain = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.r_[0, at[:-1] - plain[:-1]]
    if state == ESCAPED:
        lead = np.r_[True, plain[:-1] == -1]
        run = run + lead
    quotes = (b == ord('"')) & (run % 2 == 0)
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1
    signs = np.flatnonzero(~inside & ((b == ord("[")) | (b == ord("]")) | (b == ord("{")) | (b == ord("}")) | (b == ord(","))))
    if not inside[-1]:
        end = OUTSIDE
    else:
        end = ESCAPED if slash[-1] and (run[-1] + 1) % 2 == 1 else INSIDE
    return signs, b[signs], end


def _turns(kinds: np.ndarray) -> np.ndarray:
    opened = (kinds == ord("[")) | (kinds == ord("{"))
    closed = (kinds == ord("]")) | (kinds == ord("}"))
    return opened.astype(np.int64) - closed


def borders(signs: np.ndarray, kinds: np.ndarray, depth: int) -> np.ndarray:
    """Places of the signs that part the items of the top-level array: its brackets and commas."""
    after = depth + np.cumsum(_turns(kinds))
    comma = (kinds == ord(",")) & (after == 1)
    ends = ((kinds == ord("[")) & (after == 1)) | ((kinds == ord("]")) & (after == 0))
    return signs[comma | ends]


def _open(path: str):
    system, name = arrow_fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def split_json_arrays(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, glob: str = "*") -> DataFrame:
    """``(path, start, raw)``: every item of the top-level array of JSON files, as it stands there.

    ``start`` is the byte after the border before it. Files are cut into ranges of bytes. A
    first pass tells for each range what it does to each state that it might begin in (between
    values, in a string, after a backslash) and how much deeper it ends; a file's ranges, one
    short row each, are then put in order to know each one's true state and depth; a second
    pass gives out the items whose border lies in the range, reading on behind it for the
    last one. So a task holds one range and one item, whatever the size of the file.
    Files whose value is no array give nothing. ``path`` is an address that Arrow's file systems know.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length").filter("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("length") - F.col("start"), F.lit(range_bytes).cast("long")).alias("size"))
    # One range is one piece of work, also when a single file has them all.
    count = ranges.count()
    ranges = ranges.repartition(max(1, min(count, 20_000)), "path", "start")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(name) as file:
                    data = file.read_at(size, start)
                first = data.lstrip()[:1] == b"[" if start == 0 else None
                ends, deeper = [], []
                for state in (OUTSIDE, INSIDE, ESCAPED):
                    _, kinds, end = structure(data, state)
                    ends.append(end)
                    deeper.append(int(_turns(kinds).sum()))
                rows.append((name, start, size, first, ends, deeper))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], shape)

    shape = pa.schema(
        [("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("is_array", pa.bool_()),
         ("ends", pa.list_(pa.int32())), ("deeper", pa.list_(pa.int64()))]
    )
    looked = ranges.mapInArrow(look, "path string, start long, size long, is_array boolean, ends array<int>, deeper array<long>")

    def order(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        state, depth, states, depths = OUTSIDE, 0, [], []
        for ends, deeper in zip(rows.column("ends").to_pylist(), rows.column("deeper").to_pylist()):
            states.append(state)
            depths.append(depth)
            state, depth = ends[state], depth + deeper[state]
        keep = rows.num_rows if rows.column("is_array")[0].as_py() else 0
        return pa.table(
            {"path": rows.column("path"), "start": rows.column("start"), "size": rows.column("size"),
             "state": pa.array(states, pa.int32()), "depth": pa.array(depths, pa.int64())}
        ).slice(0, keep)

    placed = looked.groupBy("path").applyInArrow(order, "path string, start long, size long, state int, depth long")
    placed = placed.repartition(max(1, min(count, 20_000)), "path", "start")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size, state, depth in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(name) as file:
                    data = file.read_at(size, start)
                    signs, kinds, end = structure(data, state)
                    found = borders(signs, kinds, depth)
                    depth += int(_turns(kinds).sum())
                    if not len(found):
                        continue
                    # The last item goes on behind the range, unless its border closes the array.
                    closes = data[found[-1] : found[-1] + 1] == b"]"
                    last, parts, ahead = int(found[-1]) + 1, [data[int(found[-1]) + 1 :]], start + size
                    while not closes:
                        more = file.read_at(MORE_BYTES, ahead)
                        if not more:
                            break
                        signs, kinds, end = structure(more, end)
                        behind = borders(signs, kinds, depth)
                        depth += int(_turns(kinds).sum())
                        parts.append(more[: int(behind[0])] if len(behind) else more)
                        ahead += len(more)
                        closes = bool(len(behind))
                    items = [(start + int(a) + 1, data[a + 1 : z]) for a, z in zip(found[:-1], found[1:])]
                    if data[found[-1] : found[-1] + 1] != b"]":
                        items.append((start + last, b"".join(parts)))
                items = [(place, raw.strip()) for place, raw in items]
                items = [(place, raw) for place, raw in items if raw]
                places, raws = zip(*items) if items else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(items), pa.string()), pa.array(places, pa.int64()), pa.array([r.decode() for r in raws], pa.string())],
                    ["path", "start", "raw"],
                )

    return placed.mapInArrow(give, "path string, start long, raw string")


def split_json_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, glob: str = "*") -> DataFrame:
    """``text`` of every item of the JSON arrays at ``path``, as the reader of whole files gives it."""
    items = split_json_arrays(spark, path, range_bytes, glob)
    alone = F.concat(F.lit("["), "raw", F.lit("]"))
    return items.select(F.explode(json_texts(alone)).alias("text"))
