"""Tables of one job in the shared folder, removed after their last reader."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..session import remove_folder, work_folder


class Tables:
    """Writes steps of a job to Parquet below one work folder and gives the space back.

    A written table cuts lineage like a checkpoint, survives lost executors, and can be
    removed as soon as what is made from it has itself been written. Removal also
    lets Spark's cleaner delete the shuffle files of steps that nothing refers to any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder = spark, work_folder(spark, label)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.number = 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}"
        self.number += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables of this job but these."""
        kept = {id(t) for t in tables}
        self.drop(*[table for number, (table, _) in list(self.paths.items()) if number not in kept])

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this job; what was not written by it is left alone."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                remove_folder(self.spark, path)
        gc.collect()
        self.spark._jvm.java.lang.System.gc()
