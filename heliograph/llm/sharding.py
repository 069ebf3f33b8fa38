"""Sharding by sampled splitters.

Records are ordered by (hash of their group, hash of their id and place).  A size-weighted
sample of those keys gives quantile boundaries; records are range-partitioned by
them and every range is measured exactly.  A range that came out overfull is
sampled again, more densely, and subdivided, until none is left; a record that is heavier
than a range has one to itself.  Ranges are then dealt to shards, largest first to
the emptiest shard, so shard sizes differ by about one light range.

Equal groups (equal texts, say) stay in one shard: boundaries are moved to group
edges.  A group too heavy for one range gets ranges of its own; only a group that
exceeds a whole shard's fair share is spread over several shards, by id.

Rows are written once with their keys, so that rows alike in group and id (nulls, say)
have different keys that stay the same when a task runs again; pass what is to be sharded,
or ids and sizes only.  The driver sees the sample, the boundaries and one row per range, all bounded by
parameters.  Records are shuffled once, by range, for their slot numbers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.tables import without
from heliograph.storage import Scratch

LEAST = -(1 << 63)


def _packed(k: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Pairs of signed longs as 16-byte strings that sort like the pairs."""
    out = np.empty((len(k), 2), dtype=">u8")
    out[:, 0] = k.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = r.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(out).view("S16").ravel() if len(out) else np.empty(0, "S16")


def _range_of(bounds: list[tuple[int, int]]):
    """A vectorised column function: how many boundaries are at or below (k, r)."""
    edges = _packed(np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64))

    @F.pandas_udf("int")
    def number(k: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _packed(k.to_numpy(), r.to_numpy()), side="right").astype(np.int32))

    return number


def _aligned(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Boundaries moved to group edges; a group hit by several keeps its inner ones and is fenced off."""
    by_group: dict[int, list[int]] = {}
    for k, r in points:
        by_group.setdefault(k, []).append(r)
    out = set()
    for k, inner in by_group.items():
        out.add((k, LEAST))
        if len(inner) > 1:
            out.update((k, r) for r in inner)
            if k < (1 << 63) - 1:
                out.add((k + 1, LEAST))
    return sorted(out)


def shard_by_size(
    df: DataFrame, n_shards: int, size: Column, group: Column, row_id: Column, *, ranges_per_shard: int = 256, oversample: int = 8, max_rounds: int = 30
) -> DataFrame:
    """``df`` plus shard int (0..n_shards-1), slot long (gapless from 0 in a shard) and range_id int.

    ``size`` is a positive long (null counts 1), ``group`` what must stay together,
    ``row_id`` what breaks ties.  Null groups form one group; repeated rows are rows
    each; very long records have a range each; an empty table gives an empty result; input columns named like the
    outputs are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    base = without(df, "shard", "slot", "range_id")
    scratch = Scratch(spark, "shards")
    tagged = base.withColumns({"__size": F.coalesce(size.cast("long"), F.lit(1)), "__k": F.xxhash64(group), "__r": F.xxhash64(row_id, F.monotonically_increasing_id())})
    tagged = scratch.table(tagged, "rows")
    keys = tagged.select("__k", "__r", F.col("__size").alias("bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return base.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long"), "range_id": F.lit(0)}).limit(0)

    n_ranges = n_shards * ranges_per_shard

    full = 2 * total / n_ranges

    def draw(rows: DataFrame, wanted: int, weight: int, seed: int) -> list[tuple[int, int, int]]:
        """About ``wanted`` keys with their bytes, each with a chance in proportion to those."""
        u = F.shiftrightunsigned(F.xxhash64("__k", "__r", F.lit(seed)), 11) / F.lit(float(1 << 53))
        return sorted(map(tuple, rows.where(u < F.col("bytes") * F.lit(wanted / weight)).select("__k", "__r", "bytes").collect()))

    def quantiles(drawn: list[tuple[int, int, int]], every: int) -> set[tuple[int, int]]:
        """Every so many keys, and both edges of a record that overfills a range alone."""
        heavy = {(k, x) for k, r, b in drawn if b > full for x in (r, r + 1) if x < 1 << 63}
        return {(k, r) for k, r, _ in drawn[every - 1 :: every]} | heavy

    def measured(bounds: list[tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
        """(bytes, rows, bytes of the heaviest record) by range."""
        rows = keys.groupBy(_range_of(bounds)("__k", "__r").alias("g")).agg(F.sum("bytes"), F.count("*"), F.max("bytes")).collect()
        return {x[0]: (x[1], x[2], x[3]) for x in rows}

    points = quantiles(draw(keys, n_ranges * oversample, total, 1), oversample)
    bounds = _aligned(sorted(points))
    sizes = measured(bounds)
    for seed in range(2, max_rounds):
        over = [g for g, (b, _, heaviest) in sizes.items() if b - heaviest > full]
        if not over:
            break
        weight = sum(sizes[g][0] for g in over)
        wanted = max(oversample * 2 * len(over), int(weight / total * n_ranges * oversample)) * (1 + seed // 4)
        crowded = keys.withColumn("g", _range_of(bounds)("__k", "__r")).join(F.broadcast(spark.createDataFrame([(g,) for g in over], "g int")), "g", "left_semi")
        drawn = draw(crowded, wanted, weight, seed)
        points |= quantiles(drawn, max(1, min(oversample // 2, len(drawn) // (2 * len(over)))))
        bounds = _aligned(sorted(points))
        sizes = measured(bounds)
    else:
        raise RuntimeError(f"{len(over)} ranges are still overfull after {max_rounds} rounds")

    def lone(g: int) -> int | None:
        """The group that range g lies in, if the range is fenced off for it."""
        lo, hi = bounds[g - 1] if g else None, bounds[g] if g < len(bounds) else None
        if lo and hi and (hi == (lo[0] + 1, LEAST) or hi[0] == lo[0]):
            return lo[0]
        return None

    units: dict[tuple, list[int]] = {}
    for g in sorted(sizes):
        k = lone(g)
        units.setdefault(("range", g) if k is None else ("group", k), []).append(g)
    fair = total / n_shards
    weighed = []
    for ranges in units.values():
        whole = sum(sizes[g][0] for g in ranges)
        weighed += [(whole, ranges)] if whole <= fair else [(sizes[g][0], [g]) for g in ranges]
    load = [(0, s) for s in range(n_shards)]
    heapq.heapify(load)
    shard_of: dict[int, int] = {}
    for whole, ranges in sorted(weighed, key=lambda x: (-x[0], x[1])):
        filled, s = heapq.heappop(load)
        shard_of.update(dict.fromkeys(ranges, s))
        heapq.heappush(load, (filled + whole, s))
    first, plan = [0] * n_shards, []
    for g in sorted(sizes):
        s = shard_of[g]
        plan.append((g, s, first[s]))
        first[s] += sizes[g][1]

    from pyspark.sql import Window

    dealt = tagged.withColumn("range_id", _range_of(bounds)("__k", "__r")).join(
        F.broadcast(spark.createDataFrame(plan, "range_id int, shard int, __first long")), "range_id"
    )
    rank = F.row_number().over(Window.partitionBy("range_id").orderBy("__k", "__r"))
    return dealt.withColumn("slot", F.col("__first") + rank - 1).select(*[f"`{c}`" for c in base.columns], "shard", "slot", "range_id")


def op2_sampled_splitters(spark, sf_dir):
    """All documents into 8 shards of near equal bytes."""
    from heliograph.llm.tables import read

    text = F.coalesce("text", F.lit(""))
    slim = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),  # a null text goes with the empty ones
    )
    slim = Scratch(spark, "op2").table(slim, "slim")
    out = shard_by_size(slim, 8, F.col("size"), F.col("text_key"), F.col("doc_id"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id"
    )
