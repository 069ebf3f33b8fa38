"""Small helpers the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator is about to use for its own output."""
    taken = {n.lower() for n in names}
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """Schema of ``df`` plus ``fields``, for mapInArrow functions that append columns."""
    return T.StructType([*df.schema.fields, *fields])


def tidy(run):
    """A mapInArrow function that gives its memory back to the system when its task ends, as Spark keeps Python workers for later tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied
