"""A saved vector index: coarse cells, product-quantised residuals, exact re-scoring.

The index is three small tables and two partitioned ones below one folder:
``centres`` and ``codebook`` (bounded by parameters), ``codes`` (a byte per
sub-vector, partitioned by cell) and ``vectors`` (whole vectors, partitioned by
their home cell). A search reads the codes of the probed cells, then only the whole
vectors of the homes of its best candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .nearest import WAVES, RunningBest, _sum_in_order, fit_cells
from .scaling import keep_top

SAMPLE_ROWS = 50_000
CODES = 256
ROUNDS = 12
# Queries and codes of a group, and rows of one batch of queries by cell.
QUERY_ROWS, CODE_ROWS, ENTERED_ROWS = 4_000, 50_000, 10_000
TILE = 4_000_000
# Pairs whose exact distances are taken at a time.
PAIRS = 200_000
# Bounds and distances are compared with this much room for rounding.
ROOM = 1e-5


@dataclass
class Codec:
    """Cell centres with their radius, and the codebook of every sub-vector."""

    centres: np.ndarray
    radius: np.ndarray
    books: list[np.ndarray]

    def __post_init__(self):
        edges = np.cumsum([0, *(b.shape[1] for b in self.books)])
        self.spans = list(zip(edges[:-1], edges[1:]))

    def cell_gaps(self, rows: np.ndarray) -> np.ndarray:
        """Distance of every row to every centre."""
        squares = (rows**2).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * rows @ self.centres.T
        return np.sqrt(np.maximum(squares, 0))

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        codes = np.empty((len(residuals), len(self.books)), np.uint8)
        for m, (start, end) in enumerate(self.spans):
            part, book = residuals[:, start:end], self.books[m]
            codes[:, m] = ((book**2).sum(1)[None] - 2 * part @ book.T).argmin(1)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)


def _lloyd(rows: np.ndarray, codes: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of plain k-means; the same for the same rows in any order."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= codes:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), codes, replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=codes)
        sums = np.stack([np.bincount(near, rows[:, d], codes) for d in range(rows.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def training_sample(stored: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """About ``sample_rows`` rows by a hash of their id, all if there are no more."""
    rows = stored.count()
    chosen = F.pmod(F.xxhash64(F.col("vector_id"), F.lit(seed)), F.lit(max(rows, 1))) < sample_rows
    return stored if rows <= sample_rows else stored.filter(chosen)


def _train_books(sample: DataFrame, centres: np.ndarray, sub_vectors: int, seed: int) -> pd.DataFrame:
    """A codebook per sub-vector, each trained in a task of its own on the sample's residuals."""
    spans = np.array_split(np.arange(centres.shape[1]), sub_vectors)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("vector"))
                gaps = (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * rows @ centres.T
                residuals = rows - centres[gaps.argmin(1)]
                for m, span in enumerate(spans):
                    yield pa.RecordBatch.from_arrays([pa.array([m] * len(rows), pa.int32()), pa.array(list(residuals[:, span]))], ["sub", "part"])

    def train(part: pd.DataFrame) -> pd.DataFrame:
        sub = int(part["sub"].iloc[0])
        book = _lloyd(np.stack(part["part"].to_numpy()), CODES, ROUNDS, seed + sub)
        return pd.DataFrame({"sub": sub, "code": np.arange(len(book)), "centre": list(book)})

    cuts = sample.select("vector").mapInArrow(cut, "sub int, part array<double>")
    # ``sub_vectors`` x 256 short rows.
    return cuts.groupBy("sub").applyInPandas(train, "sub int, code int, centre array<double>").toPandas()


def build_index(
    vectors: DataFrame,
    root: str,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    cells: int = 32,
    sub_vectors: int = 16,
    copies: int = 1,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 17,
) -> None:
    """Train on a bounded sample, then encode and save every vector.

    A vector's code is kept in its ``copies`` closest cells, so that a search finds it with
    fewer probes where cells overlap; its whole vector only in the closest,
    its home. With each code go its squared length and its error (how far the
    decoded vector is from the whole one), which make distances to codes cheap and
    bounds on the true distance safe. Null vectors are left out.
    """
    spark = vectors.sparkSession
    stored = vectors.select(F.col(vector_id).alias("vector_id"), F.col(vector).alias("vector")).filter("vector is not null")
    sample = training_sample(stored, sample_rows, seed)
    model = fit_cells(sample, "vector", cells, seed)
    centres = np.array(model.clusterCenters())
    books = _train_books(sample, centres, min(sub_vectors, centres.shape[1]), seed)
    listed = [np.stack(b.sort_values("code")["centre"].to_numpy()) for _, b in books.groupby("sub")]
    codec = Codec(centres, np.zeros(len(centres)), listed)
    id_type = stored.schema["vector_id"].dataType
    kept = min(copies, len(centres))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = codec.cell_gaps(_matrix(batch.column("vector")))
                home = gaps.argmin(1)
                reach = gaps[np.arange(len(home)), home]
                columns = [*batch.columns, pa.array(home, pa.int32()), pa.array(reach)]
                yield pa.RecordBatch.from_arrays(columns, ["vector_id", "vector", "home", "reach"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vector"))
            order = np.argsort(codec.cell_gaps(rows), axis=1, kind="stable")[:, :kept]
            for place in range(kept):
                cell = order[:, place]
                codes = codec.encode(rows - codec.centres[cell])
                near = codec.centres[cell] + codec.decode(codes)
                columns = [
                    pa.array(cell, pa.int32()),
                    pa.array(order[:, 0], pa.int32()),
                    batch.column("vector_id"),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array((near**2).sum(1)),
                    pa.array(np.sqrt(((rows - near) ** 2).sum(1))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "home", "vector_id", "code", "square", "error"])

    width = stored.schema["vector"].dataType.simpleString()
    kind = id_type.simpleString()
    at_home = stored.mapInArrow(homes, f"vector_id {kind}, vector {width}, home int, reach double")
    at_home.hint("rebalance", "home").write.partitionBy("home").parquet(f"{root}/vectors")
    coded = stored.mapInArrow(encode, f"cell int, home int, vector_id {kind}, code binary, square double, error double")
    coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{root}/codes")
    # One row per cell.
    reached = spark.read.parquet(f"{root}/vectors").groupBy("home").agg(F.max("reach").alias("reach")).collect()
    radius = {r["home"]: r["reach"] for r in reached}
    rows = [(i, [float(x) for x in c], radius.get(i, -1.0)) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.parquet(f"{root}/centres")
    spark.createDataFrame(books).coalesce(1).write.parquet(f"{root}/codebook")


def read_codec(spark: SparkSession, root: str) -> Codec:
    """The trained part of a saved index; its size is set by the parameters it was built with."""
    centres = spark.read.parquet(f"{root}/centres").toPandas().sort_values("cell")
    books = spark.read.parquet(f"{root}/codebook").toPandas().sort_values(["sub", "code"])
    return Codec(
        np.stack(centres["centre"].to_numpy()),
        centres["radius"].to_numpy(),
        [np.stack(b["centre"].to_numpy()) for _, b in books.groupby("sub")],
    )


def _entered(asked: DataFrame, codec: Codec, probes: int | None) -> DataFrame:
    """The ``cell`` rows of every query: its ``probes`` closest, or all that may hold a vector within its ``limit``."""
    used = codec.radius >= 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps = codec.cell_gaps(_matrix(batch.column("query_vector")))
            if probes is None:
                limit = batch.column("limit").to_numpy(zero_copy_only=False)
                enter = gaps - codec.radius[None] <= limit[:, None] + ROOM
            else:
                order = np.argsort(np.where(used[None], gaps, np.inf), axis=1, kind="stable")[:, :probes]
                enter = np.zeros(gaps.shape, bool)
                np.put_along_axis(enter, order, True, axis=1)
            at, cells = np.nonzero(enter & used[None])
            # A piece at a time: a query may enter all cells.
            for first in range(0, len(at), ENTERED_ROWS):
                some = slice(first, first + ENTERED_ROWS)
                piece = batch.take(pa.array(at[some]))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cells[some], pa.int32())], [*batch.schema.names, "cell"])

    return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())]))


def _in_groups(left: DataFrame, right: DataFrame, run, schema: str, query_rows: int) -> DataFrame:
    """``run(cell, left, right)`` on Arrow tables of bounded size; each left row meets every right row of its cell once.

    Left rows are cut into blocks by ``query_id``, right rows into shards by
    ``vector_id``. Only the row counts of cells reach the driver.
    """
    cut = {}
    for side, rows, most in (("left", left, query_rows), ("right", right, CODE_ROWS)):
        counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cell
        parts = [-(-counts.get(c, 0) // most) for c in range(max(counts, default=-1) + 1)]
        # The last entry stands for cells that this side does not have.
        cut[side] = F.array(*[F.lit(n).cast("long") for n in [*parts, 0]]), len(parts)

    def parts_of(side: str) -> Column:
        table, known = cut[side]
        return F.element_at(table, F.least(F.col("cell"), F.lit(known)) + 1)

    def numbers(side: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), parts_of(side) - 1))

    group = ["cell", "shard", "block"]
    parts = WAVES * left.sparkSession.sparkContext.defaultParallelism
    left = left.filter(parts_of("right") > 0).withColumn("block", F.pmod(F.xxhash64("query_id"), parts_of("left")))
    left = left.withColumn("shard", numbers("right")).repartition(parts, *group)
    right = right.filter(parts_of("left") > 0).withColumn("shard", F.pmod(F.xxhash64("vector_id"), parts_of("right")))
    right = right.withColumn("block", numbers("left")).repartition(parts, *group)

    def work(key, some: pa.Table, others: pa.Table) -> pa.Table:
        return run(key[0].as_py(), some.combine_chunks(), others.combine_chunks())

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(work, schema)


def _table_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _matrix(column.combine_chunks()) if len(column) else np.zeros((0, 0))


def _decoded(codec: Codec, cell: int, codes: pa.Table) -> np.ndarray:
    flat = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
    return codec.centres[cell] + codec.decode(flat)


def _code_gaps(queries: np.ndarray, near: np.ndarray, square: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances from queries to decoded codes, some queries at a time.

    Whole queries against decoded codes: one matrix product instead of a look-up per sub-vector.
    """
    step = max(1, TILE // max(1, len(near)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        yield at, np.sqrt(np.maximum((some**2).sum(1)[:, None] + square[None] - 2 * some @ near.T, 0))


def _nearest_codes(entered: DataFrame, codes: DataFrame, codec: Codec, keep: int, query_rows: int) -> DataFrame:
    """The ``keep`` closest codes of every query and group of codes."""

    def run(cell: int, asked: pa.Table, some: pa.Table) -> pa.Table:
        rows, cols, near = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if asked.num_rows and some.num_rows:
            decoded = _decoded(codec, cell, some)
            for at, gaps in _code_gaps(_table_matrix(asked.column("query_vector")), decoded, some.column("square").to_numpy()):
                chosen = np.argpartition(gaps, keep - 1, axis=1)[:, :keep] if some.num_rows > keep else np.tile(np.arange(some.num_rows), (len(gaps), 1))
                rows.append(np.repeat(np.arange(at, at + len(gaps)), chosen.shape[1]))
                cols.append(chosen.ravel())
                near.append(np.take_along_axis(gaps, chosen, axis=1).ravel())
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        columns = [asked.column("query_id").take(row), some.column("vector_id").take(col), some.column("home").take(col), pa.array(np.concatenate(near))]
        return pa.table(columns, ["query_id", "vector_id", "home", "near"])

    kinds = entered.schema["query_id"].dataType.simpleString(), codes.schema["vector_id"].dataType.simpleString()
    return _in_groups(entered, codes, run, f"query_id {kinds[0]}, vector_id {kinds[1]}, home int, near double", query_rows)


def _found(asked: pa.Table, vectors: pa.Table, row: np.ndarray, col: np.ndarray, gaps: np.ndarray) -> pa.Table:
    columns = [asked.column("query_id").take(pa.array(row)), vectors.column("vector_id").take(pa.array(col)), pa.array(gaps)]
    return pa.table(columns, ["query_id", "vector_id", "distance"])


def _exact(found: DataFrame, asked: DataFrame, whole: DataFrame, query_rows: int) -> DataFrame:
    """True distances of candidates; only the partitions of their homes are read.

    A query meets the vectors of a home once, with the ids of its candidates there.
    """
    listed = found.groupBy("query_id", F.col("home").alias("cell")).agg(F.collect_list("vector_id").alias("wanted"))
    listed = checkpointed(listed.join(asked, "query_id"))
    homes = [r["cell"] for r in listed.select("cell").distinct().collect()]  # at most one per cell
    there = whole.filter(F.col("home").isin(homes)).withColumnRenamed("home", "cell")

    def run(cell: int, some: pa.Table, vectors: pa.Table) -> pa.Table:
        wanted = some.column("wanted").combine_chunks()
        rows, places = wanted.value_parent_indices(), pc.index_in(wanted.flatten(), vectors.column("vector_id").combine_chunks())
        # Candidates of other shards have no place.
        known = pc.is_valid(places)
        row = rows.filter(known).to_numpy(zero_copy_only=False)
        col = places.filter(known).to_numpy(zero_copy_only=False)
        left, right = _table_matrix(some.column("query_vector")), _table_matrix(vectors.column("vector"))
        gaps = [np.empty(0)]
        for at in range(0, len(row), PAIRS):
            span = slice(at, at + PAIRS)
            gaps.append(np.sqrt(_sum_in_order(left[row[span]], right[col[span]], True)))
        return _found(some, vectors, row.astype(np.int64), col.astype(np.int64), np.concatenate(gaps))

    kinds = asked.schema["query_id"].dataType.simpleString(), whole.schema["vector_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, vector_id {kinds[1]}, distance double"
    return _in_groups(listed, there, run, schema, query_rows)


def _certified(limited: DataFrame, codes: DataFrame, whole: DataFrame, codec: Codec, k: int, query_rows: int) -> DataFrame:
    """The ``k`` closest vectors of every query and group, of those whose codes leave a distance within the query's ``limit``."""
    there = codes.filter("cell = home").select("vector_id", F.col("cell"), "code", "square", "error")
    there = checkpointed(there.join(whole.withColumnRenamed("home", "cell"), ["vector_id", "cell"]))

    def run(cell: int, some: pa.Table, vectors: pa.Table) -> pa.Table:
        none = np.empty(0, np.int64)
        if not some.num_rows or not vectors.num_rows:
            return _found(some, vectors, none, none, np.empty(0))
        asked, limit = _table_matrix(some.column("query_vector")), some.column("limit").to_numpy()
        error, open_codes = vectors.column("error").to_numpy(), np.zeros(vectors.num_rows, bool)
        for at, gaps in _code_gaps(asked, _decoded(codec, cell, vectors), vectors.column("square").to_numpy()):
            open_codes |= (gaps - error[None] <= limit[at : at + len(gaps)][:, None] + ROOM).any(axis=0)
        place = np.flatnonzero(open_codes)
        if not len(place):
            return _found(some, vectors, none, none, np.empty(0))
        # Ties go to the smaller id: places are numbered in the order of ids.
        ids = np.array(vectors.column("vector_id").take(pa.array(place)).to_pylist())
        place = place[np.argsort(ids, kind="stable")]
        best = RunningBest(asked, k, "l2")
        best.add(np.arange(len(place)), _table_matrix(vectors.column("vector").take(pa.array(place))))
        row, at, gaps = best.result()
        near = gaps <= limit[row] + ROOM
        return _found(some, vectors, row[near], place[at[near]], gaps[near])

    entered = _entered(limited, codec, None)
    kinds = limited.schema["query_id"].dataType.simpleString(), whole.schema["vector_id"].dataType.simpleString()
    return _in_groups(entered, there, run, f"query_id {kinds[0]}, vector_id {kinds[1]}, distance double", query_rows)


def search_index(
    queries: DataFrame,
    root: str,
    k: int = 4,
    probes: int = 3,
    rescore: int = 64,
    certified: bool = False,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    vector_id: str = "vec_id",
    rank: str = "rk",
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` nearest vectors by Euclidean distance: ids, exact ``distance`` and rank.

    Each query enters its ``probes`` closest cells, whose folders alone are read; the
    ``rescore`` closest codes are compared with their whole vectors. A true
    neighbour is missed when it lies in no probed cell or behind that many closer codes.
    With ``certified`` nothing is missed: the k-th distance found so far and the
    codes' errors tell which other cells and codes could still hold a closer vector,
    and those are compared too. Queries and codes meet by cell in groups of at most about
    ``query_rows`` and ``CODE_ROWS`` of them; only counts of cells reach the driver. Ties
    go to the smaller id; null query vectors find nothing.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("query_vector"))
    asked = asked.filter("query_vector is not null")
    codec = read_codec(spark, root)
    codes, whole = spark.read.parquet(f"{root}/codes"), spark.read.parquet(f"{root}/vectors")
    entered = _entered(asked, codec, probes)
    cells = [r["cell"] for r in entered.select("cell").distinct().collect()]  # at most one per cell
    # Only the folders of cells that some query enters.
    rough = _nearest_codes(entered, codes.filter(F.col("cell").isin(cells)), codec, rescore, query_rows)
    # A vector's code may lie in several of the probed cells.
    once = rough.groupBy("query_id", "vector_id", "home").agg(F.min("near").alias("near"))
    best = keep_top(once, ["query_id"], [F.col("near"), F.col("vector_id")], rescore, "_place").drop("_place")
    found = _exact(best, asked, whole, query_rows)
    if certified:
        reached = keep_top(found, ["query_id"], [F.col("distance"), F.col("vector_id")], k, "_place").filter(F.col("_place") == k)
        limits = reached.select("query_id", F.col("distance").alias("limit"))
        limited = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        found = _certified(checkpointed(limited), codes, whole, codec, k, query_rows)
    top = keep_top(found, ["query_id"], [F.col("distance"), F.col("vector_id")], k, rank)
    return top.select(F.col("query_id").alias(query_id), F.col("vector_id").alias(vector_id), "distance", rank)
