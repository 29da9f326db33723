"""Building blocks that keep joins, ranks and top-k bounded whatever the skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
SPLIT_ROWS = 1_000_000
SPLIT_BYTES = 256 * 1024 * 1024
SALTS = 32
RANGE_ROWS = 50_000
FEWEST_RANGES, MOST_RANGES = 8, 20_000


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input comes in fewer pieces than there are; any larger input as it is.

    A small table is often one Parquet row group and so one task, however dear the
    work on its rows; at scale there are more pieces than cores, and nothing moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < pieces < cores else df


def _width(field: T.StructField) -> Column:
    """Approximate bytes of one value."""
    value = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        size = F.size(value) * 8 + 16
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(value)) + 16
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a row."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        size = size + _width(field)
    return size


def small_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> int | None:
    """Row count of a table measured to be small enough for every executor, else None.

    One aggregation: every task adds up its own rows and sends two numbers.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("bytes")).first()
    return seen["n"] if seen["n"] <= max_rows and (seen["bytes"] or 0) <= max_bytes else None


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    salts: int = SALTS,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    bound: int | None = None,
) -> DataFrame:
    """Equi-join that never piles one hot key on one task.

    The small side is broadcast when it is measured to fit, or when the caller
    knows a ``bound`` on its (short) rows from a limit. Otherwise the big side
    is spread over ``salts`` by a hash of its ``spread`` columns and the small
    side is repeated once per salt, so a key with a third of all rows is shared
    by many tasks.
    """
    on = list(on)
    known = bound is not None and bound <= max_rows
    if known or small_rows(small, max_rows, max_bytes) is not None:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def keep_top(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rk",
    spread: Sequence[str] = (),
    buckets: int = 64,
) -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    Spark cuts each input partition to ``k`` rows per key before the shuffle.
    With ``spread`` the cut is made once more in hashed buckets of a key, which
    keeps the last merge small when a key lives in very many partitions.
    """
    rows = df
    if spread:
        rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
        local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        rows = rows.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= k).drop(rank, "_bucket")
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def ordered_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str = "position",
    split_rows: int = SPLIT_ROWS,
    key_values: DataFrame | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """1-based position of every row among the rows of its key.

    ``order`` must end in a column that is unique within a key. Keys of at most
    ``split_rows`` rows and ``split_bytes`` bytes are numbered by a window. Larger ones are sorted across
    the cluster, checkpointed, and numbered from the row count of the sorted
    partitions before them, so no task ever holds one whole hot key. The keys
    are counted in ``key_values`` when given, a cheaper table with the same keys
    and at least as many rows of each.
    """
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    counted = df if key_values is None else key_values
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(row_bytes(counted)).alias("_bytes"))
    # At most (all rows / split_rows) + (all bytes / split_bytes) keys can be this large.
    hot = sizes.filter((F.col("_rows") > split_rows) | (F.col("_bytes") > split_bytes)).select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)])
    if hot.isEmpty():
        return df.withColumn(position, plain.cast("long"))

    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & df[key].eqNullSafe(F.col(f"_hot_{i}"))
    cold = df.join(F.broadcast(hot), same, "left_anti").withColumn(position, plain)

    heavy = df.join(F.broadcast(hot), same, "left_semi")
    heavy = heavy.orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order)
    heavy = checkpointed(heavy.withColumn("_row", F.monotonically_increasing_id()))
    heavy = heavy.withColumn("_part", F.shiftright("_row", 33))
    runs = heavy.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(k).alias(f"_run_{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_run_part"),
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    same_run = F.col("_part") == F.col("_run_part")
    for i, key in enumerate(keys):
        same_run = same_run & F.col(key).eqNullSafe(F.col(f"_run_{i}"))
    # One row per hot key and sorted partition: bounded by their number.
    numbered = heavy.join(F.broadcast(runs), same_run).withColumn(
        position, F.col("_before") + F.col("_row") - F.col("_first") + 1
    )
    columns = [*df.columns, position]
    return cold.withColumn(position, F.col(position).cast("long")).select(*columns).unionByName(
        numbered.select(*columns)
    )


def range_limits(df: DataFrame, column: str, rows_per_range: int, most: int) -> list[float]:
    """Split points that cut ``df`` into ranges of similar row counts.

    At most ``most`` numbers reach the driver. The points only steer where rows
    go; they never decide a result.
    """
    rows = df.count()
    ranges = max(FEWEST_RANGES, min(most, -(-rows // rows_per_range)))
    shares = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 10 * ranges)).alias("p")).first()["p"]
    return sorted({float(p) for p in found or []})


def in_ranges(df: DataFrame, column: str, limits: Sequence[float], out: str) -> DataFrame:
    """Add the 0-based number of the range a numeric column falls into."""
    if not limits:
        return df.withColumn(out, F.lit(0))
    splits = [-float("inf"), *limits, float("inf")]
    placed = df.withColumn("_order", F.col(column).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_order", outputCol=out).transform(placed)
    return bucketed.withColumn(out, F.col(out).cast("int")).drop("_order")


def running_start(
    df: DataFrame,
    order: str,
    amount: str,
    start: str = "start",
    rows_per_range: int = RANGE_ROWS,
    most_ranges: int = MOST_RANGES,
    order_values: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``amount`` over all rows that come earlier by the unique numeric ``order``.

    Only (order, amount) rows are ranged and numbered; the sums are joined back
    by the order column. Totals per range give each range its offset, a window
    inside the range does the rest, so no task sees the whole table however
    small or large it is. The numbers come from ``order_values`` when that has both
    columns, a cheaper table of the same rows.
    """
    cheap = order_values is not None and {order, amount} <= set(order_values.columns)
    narrow = (order_values if cheap else df).select(order, amount)
    limits = range_limits(narrow.select(order), order, rows_per_range, most_ranges)
    ranged = in_ranges(narrow, order, limits, "_range")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(amount).over(inside), F.lit(0).cast("long"))
    # One total per range, at most ``most_ranges`` of them.
    totals = {r["_range"]: r["total"] or 0 for r in ranged.groupBy("_range").agg(F.sum(amount).alias("total")).collect()}
    offsets, before = [], 0
    for number in range(len(limits) + 1):
        offsets.append(before)
        before += totals.get(number, 0)
    table = F.array(*[F.lit(o).cast("long") for o in offsets])
    starts = ranged.select(F.col(order), (local + F.element_at(table, F.col("_range") + 1)).alias(start))
    return df.join(starts, order)


def running_in_key(
    df: DataFrame, keys: Sequence[str], position: str, amount: str, start: str, segment_rows: int
) -> DataFrame:
    """Sum of ``amount`` over the rows before by the 1-based ``position`` of a key.

    A key is cut into segments of ``segment_rows`` positions; totals of the
    segments give the offset of each, a window inside the segment does the rest.
    """
    cut = df.withColumn("_segment", F.floor((F.col(position) - 1) / F.lit(segment_rows)))
    totals = cut.groupBy(*keys, "_segment").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_segment").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = summed.join(totals, [*keys, "_segment"])
    return joined.withColumn(start, (F.col("_before") + F.col("_inside")).cast("long")).drop("_segment", "_before", "_inside")


def global_position(df: DataFrame, order: Sequence[Column], position: str = "position") -> DataFrame:
    """1-based position of every row in a total order, without a task that sees all rows.

    Rows are sorted across the cluster and checkpointed; each sorted partition
    starts after the rows of those before it.
    """
    rows = checkpointed(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")).collect()  # one per partition
    before, starts = 0, {}
    for run in sorted(runs, key=lambda r: r["_part"]):
        starts[run["_part"]] = before - run["_first"]
        before += run["_rows"]
    if not starts:
        return rows.withColumn(position, F.lit(0).cast("long")).drop("_row", "_part")
    table = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts) + 1)])
    shift = F.element_at(table, F.col("_part").cast("int") + 1)
    return rows.withColumn(position, F.col("_row") + shift + 1).drop("_row", "_part")
