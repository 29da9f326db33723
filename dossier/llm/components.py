"""Connected groups of a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder, work_folder


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node of its group) for every node with a link.

    Labels go to neighbours and then jump to the label of their label, so stars
    take two rounds and chains a number that grows with the logarithm of their
    length. Each round is an aggregation and two joins over narrow rows, partly
    aggregated before the shuffle, written to a table in the shared folder and
    read back, which keeps the plan of a round as small as that of the first.
    Nulls link nothing.
    """
    spark = links.sparkSession
    folder = work_folder(spark, "components")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component"))
    labels = written(labels, "0")
    for number in itertools.count(1):
        at = labels.select(F.col("node").alias("b"), F.col("component").alias("near"))
        near = both.join(at, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        lowered = labels.join(near, "node").withColumn("low", F.least("component", "near"))
        # On to the label of the label, from the labels of this round.
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        jumped = lowered.join(up, "low", "left").select(
            "node", F.col("component").alias("was"), F.least("low", F.coalesce("up", "low")).alias("component")
        )
        jumped = written(jumped, str(number))
        remove_folder(spark, f"{folder}/{number - 1}")
        labels = jumped.select("node", "component")
        if jumped.filter("was <> component").isEmpty():
            remove_folder(spark, f"{folder}/links")
            return labels
