"""Skew-proof building blocks: hot keys must give the plain answer."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dossier.operators import scaling


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key, another key is null."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 11).cast("string"))
    )
    return spark.range(6000).select(
        F.col("id"), key.alias("key"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("score")
    ).cache()


def rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("split_rows", [100, 1500, 10**9])
def test_ordered_position(skewed, split_rows):
    order = [F.col("score").desc(), F.col("id")]
    plain = skewed.withColumn(
        "position", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long")
    )
    split = scaling.ordered_position(skewed, ["key"], order, split_rows=split_rows)
    assert rows(split.select("id", "key", "position")) == rows(plain.select("id", "key", "position"))


@pytest.mark.parametrize("rows_per_range", [37, 1000, 10**9])
def test_running_start(skewed, rows_per_range):
    plain = skewed.withColumn(
        "start",
        F.coalesce(F.sum("score").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    split = scaling.running_start(skewed, "id", "score", rows_per_range=rows_per_range)
    assert rows(split.select("id", "start")) == rows(plain.select("id", "start"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_join_small_both_ways(spark, skewed, how):
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4)], "key string, v int")
    plain = skewed.join(small, ["key"], how)
    salted = scaling.join_small(skewed, small, ["key"], how, spread=["id"], max_rows=1)
    sent = scaling.join_small(skewed, small, ["key"], how, spread=["id"])
    assert rows(salted.select(*plain.columns)) == rows(plain)
    assert rows(sent.select(*plain.columns)) == rows(plain)


def test_small_rows(skewed):
    assert scaling.small_rows(skewed) == 6000
    assert scaling.small_rows(skewed, max_rows=5999) is None
    assert scaling.small_rows(skewed, max_bytes=1000) is None


@pytest.mark.parametrize("spread", [(), ("id",)])
def test_keep_top(skewed, spread):
    order = [F.col("score").desc(), F.col("id")]
    plain = skewed.withColumn("rk", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("rk <= 5")
    top = scaling.keep_top(skewed, ["key"], order, 5, spread=spread)
    assert rows(top.select("key", "id", "rk")) == rows(plain.select("key", "id", "rk"))
