"""Perceptual hashes of grey pictures of 32 x 32, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIDE, LOW = 32, 8
#: Pictures worked on at once: 8 MB as doubles.
STEP = 1024
#: The first LOW rows of the type-II cosine transform of SIDE values.
COSINES = 2 * np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE)[None, :] + 1) / (2 * SIDE))


def hash_of(pixels: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of (n, SIDE, SIDE) pictures: which of the LOW x LOW lowest frequencies exceed their median, row by row from the highest bit."""
    low = np.round(COSINES @ pixels.astype(np.float64) @ COSINES.T, 6).reshape(len(pixels), LOW * LOW)
    bits = low > np.median(low, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def _hashes(pictures: pa.Array) -> pa.Array:
    """The hashes of some pictures, which stay in Arrow's and NumPy's arrays: a list of a picture's numbers takes many times their bytes."""
    values, sizes = pictures.flatten(), pc.fill_null(pc.list_value_length(pictures), 0).to_numpy(zero_copy_only=False)
    holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
    stops = np.cumsum(sizes)
    fit = (sizes == SIDE * SIDE) & (holes[stops] == holes[stops - sizes])
    out = np.zeros(len(sizes), np.int64)
    if fit.any():
        own = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        out[fit] = hash_of(own[np.repeat(fit, sizes)].reshape(-1, SIDE, SIDE))
    return pa.array(out, mask=~fit)


def with_perceptual_hash(df: DataFrame, pixels: str = "pixels", out: str = "phash") -> DataFrame:
    """``df`` with the hash ``out`` (long) in place of an array of SIDE * SIDE grey values, line by line.

    Null for a null array, one of another length or one with a null.
    """
    rest = [f for f in df.schema.fields if f.name not in (pixels, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hashes(batch.column(len(rest)).slice(at, STEP)) for at in range(0, batch.num_rows, STEP)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.concat_arrays([pa.array([], pa.int64()), *hashes])], [*(f.name for f in rest), out])

    return df.select(*(f"`{f.name}`" for f in rest), pixels).mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))
