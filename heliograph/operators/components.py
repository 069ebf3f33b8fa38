"""Connected components of an undirected graph held as an edge table.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every round keeps the components and
shortens all paths, so a chain of n nodes takes about log(n) rounds.  A hub's
edges never meet in one task: the minimum of its neighbours is a partial
aggregate, and the join that brings it back can be split by adaptive execution.

A round is seven stages or so, and the driver keeps a record of each task.  So a round
has as many tasks as its edges need, however many shuffle partitions are set.  Minima
of few edges, whose number is known, are broadcast; others are sorted and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.storage import Scratch

#: Edges for which a round has one more task, beyond one a core.
PART_EDGES = 25_000
#: Edges up to which a step's minima, at most one for each end, are broadcast (about 5 MB).
FEW_EDGES = 50_000


def _star(edges: DataFrame, large: bool, tasks: int, few: bool) -> DataFrame:
    """One step over edges (u, v) with u > v, in stages of ``tasks`` tasks; returns edges of the same form."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = least.coalesce(tasks)
    joined = near.join(F.broadcast(least) if few else least.hint("merge"), F.col("u") == F.col("w"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
    return moved.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over an edge table whose size has been checked."""
    parent: dict = {}

    def find(a):
        top = parent.setdefault(a, a)
        while parent[top] != top:
            top = parent[top]
        while parent[a] != top:
            parent[a], a = top, parent[a]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(n) for n in nodes], kind)], ["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task_edges: int = 0) -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches.

    A graph of at most ``one_task_edges`` distinct edges (checked; off by default) is
    solved by one task instead of rounds of joins; the result is the same.

    Self-loops, repeated edges and edges with a null end add nothing.  The rounds
    stop when a round changes no edge; ``max_rounds`` only guards against a loop.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))

    def written(df: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
        """The table and its mark (rows, digest), observed while it is written: one job a round."""
        seen = Observation()
        table = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("digest")), name)
        return table, (seen.get["n"], seen.get["digest"])

    current, before = written(ends.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "round0")
    if before[0] <= one_task_edges:
        kind = current.schema["u"].dataType
        schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
        return current.coalesce(1).mapInArrow(_in_one_task, schema)
    for k in range(1, max_rounds + 1):
        if before[0] == 0:
            break
        tasks = max(spark.sparkContext.defaultParallelism, before[0] // PART_EDGES)
        size = {"tasks": tasks, "few": before[0] <= FEW_EDGES}
        current, after = written(_star(_star(current, large=True, **size), large=False, **size), f"round{k}")
        scratch.drop(f"round{k - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
