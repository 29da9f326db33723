"""Versioned names: parse, highest, next and latest per family."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import claim, file_names


def any_version(name: Column) -> Column:
    """Number after a ``v`` anywhere in the name, null when there is none."""
    return F.nullif(F.regexp_extract(name, r"v(\d+)", 1), F.lit("")).try_cast("int")


def exact_version(name: Column) -> Column:
    """Number of a name that is ``v<digits>`` and nothing else."""
    return F.nullif(F.regexp_extract(name, r"\Av(\d+)\z", 1), F.lit("")).try_cast("int")


def leading_version(name: Column) -> Column:
    """Number of a name that starts ``v<digits>`` up to the first underscore."""
    return F.nullif(F.regexp_extract(name, r"\Av(\d+)(?:_|\z)", 1), F.lit("")).try_cast("int")


def highest_version(registry: DataFrame, family: str = "family", version: str = "version") -> DataFrame:
    return registry.groupBy(family).agg(F.max(version).alias("highest"))


def next_version(
    registry: DataFrame, mode: str = "after_highest", family: str = "family", version: str = "version"
) -> DataFrame:
    """The next version per family.

    ``after_highest`` adds one to the highest; ``first_free`` takes the lowest
    number from 1 that is not taken. The latter looks for numbers whose
    predecessor exists (or is 0) but which do not, by an anti join on (family,
    number), so a family with very many versions stays spread over tasks.
    """
    if mode == "after_highest":
        return registry.groupBy(family).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next"))
    if mode != "first_free":
        raise ValueError("mode is 'after_highest' or 'first_free'")
    taken = registry.select(family, F.col(version).cast("int").alias("next")).distinct()
    candidates = taken.filter("next >= 1").select(family, (F.col("next") + 1).alias("next"))
    candidates = candidates.unionByName(taken.select(family, F.lit(1).alias("next")))
    free = candidates.join(taken, [family, "next"], "left_anti")
    return free.groupBy(family).agg(F.min("next").alias("next"))


def latest_path(
    registry: DataFrame, family: str = "family", version: str = "version", path: str = "path"
) -> DataFrame:
    """Highest version and its path; rows without a version do not count."""
    known = registry.filter(F.col(version).isNotNull())
    return known.groupBy(family).agg(
        F.max(version).alias("version"), F.max_by(path, F.struct(F.col(version), F.col(path))).alias("path")
    )


def claimed_versions(spark: SparkSession, root: str) -> DataFrame:
    """``(family, version)`` of every claim below ``root``."""
    names = [n.rpartition("-v") for n in file_names(spark, root)]
    return spark.createDataFrame([(unquote(f), int(v)) for f, _, v in names], "family string, version int")


def claim_next(
    registry: DataFrame, root: str, mode: str = "first_free", family: str = "family", version: str = "version"
) -> DataFrame:
    """``(family, version)``: a version for every family of the registry that no other caller gets.

    Numbers are computed over the registry and earlier claims, then claimed by an
    atomic create below ``root``; a family that another writer was faster for is
    computed again. The families pass through the driver one by one.
    """
    spark = registry.sparkSession
    known = registry.select(F.col(family).cast("string").alias("family"), F.col(version).cast("int").alias("version"))
    left, got = known, []
    while True:
        wanted = next_version(left.unionByName(claimed_versions(spark, root).join(left.select("family").distinct(), "family", "left_semi")), mode)
        lost = []
        for row in wanted.toLocalIterator():
            if claim(spark, f"{root}/{quote(row['family'], safe='')}-v{row['next']}"):
                got.append((row["family"], row["next"]))
            else:
                lost.append((row["family"],))
        if not lost:
            return spark.createDataFrame(got, "family string, version int")
        left = known.join(F.broadcast(spark.createDataFrame(lost, "family string")), "family", "left_semi")
