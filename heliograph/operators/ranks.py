"""Row numbers without a task that holds a whole group.

Rows are dealt by ranges of (group, order) and sorted within the ranges, so a hot
group is spread over as many tasks as its rows fill; a row's number is its place in
its range plus the rows of its group in earlier ranges.  Only one row for each group
and range takes part in the running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.storage import Scratch, join_checked


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` plus the 0-based long ``rank`` of every row within its group and, if asked for, the ``size`` of the group.

    Nulls are a group of their own.  Rows alike in group and order stand in one range and
    are numbered in any order; add a column that tells them apart where they may be many.
    ``df`` is read twice, once to draw the ranges: pass a written table.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    keys = [*map(F.col, group), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = scratch.table(dealt, "dealt").withColumn("__range", F.shiftright("__at", 33))
    spans = dealt.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    spans = scratch.table(spans, "spans")
    upto, whole = Window.partitionBy(*group).orderBy("__range"), Window.partitionBy(*group)
    spans = spans.select(
        *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__range").alias("__r"), (F.sum("__n").over(upto) - F.col("__n") - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("__all"),
    )
    on = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = {c: F.col(c) for c in df.columns if c not in (rank, size)} | {rank: F.col("__at") + F.col("__shift")} | ({size: F.col("__all")} if size else {})
    return join_checked(dealt, spans, on).select(*(c.alias(n) for n, c in out.items()))
