"""Facts about each file: size and time from the walk, content hash in the JVM, and an injectable decoder for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "path string, width int, height int, phash long, exif string, error string"


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, sha256) of all files below a folder; the contents never leave the JVM."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def decoded(files: DataFrame, decode: Callable[[bytes], dict]) -> DataFrame:
    """``decode(content)`` gives width, height, phash and exif; what it cannot decode becomes a row with an error.

    ``files`` has path and content.  No image codec ships with the library.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    got = decode(content)
                    rows.append((path, got.get("width"), got.get("height"), got.get("phash"), got.get("exif"), None))
                except Exception as e:  # a file that cannot be decoded must not end the scan
                    rows.append((path, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "phash", "exif", "error"]).astype({"width": "Int32", "height": "Int32", "phash": "Int64"})

    return files.select("path", "content").mapInPandas(run, FACTS)


def coerce_json(value, width: int = 256, most: int = 16):
    """A metadata value as JSON can hold it, or None: strings cut and without NULs, rationals as floats, short lists."""
    if value is None or isinstance(value, bool | int | float):
        return value
    if isinstance(value, str):
        return value.replace("\0", "")[:width]
    if isinstance(value, list | tuple):
        return [x for x in (coerce_json(v) for v in value) if x is not None][:most]
    if hasattr(value, "numerator") and hasattr(value, "denominator"):
        return float(value) if value.denominator else None
    return None
