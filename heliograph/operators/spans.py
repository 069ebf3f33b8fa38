"""Which trace spans are worth keeping: what is refused takes all below it along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.storage import Scratch


def refused() -> Column:
    """Preflight requests, and outgoing calls that no span of ours made."""
    preflight = (F.col("kind") == "server") & (F.col("method") == "OPTIONS")
    return F.coalesce(preflight, F.lit(False)) | F.coalesce((F.col("kind") == "client") & F.col("parent_id").isNull(), F.lit(False))


def kept_spans(spans: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``spans`` (span_id, parent_id, kind, method, ...) without the refused ones and whatever lies below one.

    Every span looks up a step, then two, then four: after as many rounds as the deepest
    branch has binary digits all ancestors have been asked.  A parent that is not in the
    table refuses nothing.  Only ids and flags go round; spans without a parent settle at once.
    """
    scratch = Scratch(spans.sparkSession, "spans")
    flags = scratch.table(spans.select("span_id", F.col("parent_id").alias("up"), refused().alias("out")), "flags0")
    for k in range(1, max_rounds + 1):
        above = flags.select(F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("out").alias("above_out"))
        open_ones = flags.where(~F.col("out") & F.col("up").isNotNull()).join(above, "up", "left")
        moved = open_ones.select("span_id", F.when(~F.coalesce("above_out", F.lit(False)), F.col("next")).alias("up"), F.coalesce("above_out", F.lit(False)).alias("out"))
        flags = scratch.table(flags.where(F.col("out") | F.col("up").isNull()).unionByName(moved), f"flags{k}")
        scratch.drop(f"flags{k - 1}")
        if flags.where("not out and up is not null").isEmpty():
            return spans.join(flags.where("not out").select("span_id"), "span_id", "left_semi")
    raise RuntimeError(f"spans did not settle in {max_rounds} rounds: do their parents form a ring?")


#: Attributes that may hold an address are cut to its path; those that may hold its query are emptied.
PATH_ONLY = ("http.url", "http.target", "url.full", "url.path")
CLEARED = ("url.query",)


def redacted(spans: DataFrame, attributes: str = "attributes", path: str = "path") -> DataFrame:
    """Spans whose map of attributes names no folder or file: addresses become the request's path, values that look like paths go."""
    kept = F.map_filter(attributes, lambda k, v: k.isin(*PATH_ONLY, *CLEARED) | ~(F.coalesce(F.contains(v, F.lit("/")), F.lit(False)) | F.coalesce(F.startswith(v, F.lit("~")), F.lit(False))))
    cut = F.transform_values(kept, lambda k, v: F.when(k.isin(*CLEARED), F.lit("")).when(k.isin(*PATH_ONLY), F.coalesce(path, F.lit(""))).otherwise(v))
    return spans.withColumn(attributes, cut)
