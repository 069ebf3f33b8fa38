"""Published snapshots of the catalog's tables: write aside, then add the new version's name to a list that only grows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """Versions of a table below one folder; readers see the newest one that the list names, or the one before while a name is being added."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def publish(self, df: DataFrame, name: str, *sort: str) -> str:
        """Write a version, rows sorted within files so that row groups can be skipped, then point to it."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        out = df.sortWithinPartitions(*sort) if sort else df
        out.write.parquet(f"{self.base}/{name}/{version}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").text(f"{self.base}/{name}/_versions")
        return version

    def read(self, name: str) -> DataFrame:
        version = self.spark.read.text(f"{self.base}/{name}/_versions").agg(F.max("value")).first()[0]
        return self.spark.read.parquet(f"{self.base}/{name}/{version}")
