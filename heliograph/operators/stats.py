"""Statistics of the library, its duplicates and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.library import is_active


def _total(col) -> F.Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("long")


def duplicate_preview(photos: DataFrame) -> DataFrame:
    """Groups of byte-identical active photos: how many, extra copies, and bytes to win by the copies' count."""
    per = photos.where(is_active() & F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("n"), F.max("size_bytes").alias("size")).where("n > 1")
    return per.agg(F.count("*").alias("duplicate_groups"), _total(F.col("n") - 1).alias("duplicate_photos"), _total((F.col("n") - 1) * F.col("size")).alias("reclaimable_bytes"))


def active_count(photos: DataFrame) -> DataFrame:
    return photos.where(is_active()).agg(F.count("*").alias("photos"), _total("size_bytes").alias("total_bytes"))


def folder_count(photos: DataFrame) -> DataFrame:
    return photos.where(is_active()).agg(F.countDistinct("directory").alias("folders"))


def last_scan(scans: DataFrame) -> DataFrame:
    return scans.where("status = 'completed'").agg(F.max("finished_at").alias("last_scan_at"))


def delete_tally(operations: DataFrame) -> DataFrame:
    return operations.where("op = 'delete'").agg(F.count("*").alias("deleted_count"), _total("size_bytes").alias("space_saved"))


def stats_bundle(photos: DataFrame, scans: DataFrame, operations: DataFrame) -> DataFrame:
    """All figures in one row: one pass over the photos for the counts, one for the duplicates; the parts are single rows."""
    counts = photos.agg(
        F.count_if(is_active()).alias("photos"),
        _total(F.when(is_active(), F.col("size_bytes"))).alias("total_bytes"),
        F.countDistinct(F.when(is_active(), F.col("directory"))).alias("folders"),
        F.count_if(F.col("status") == "missing").alias("missing"),
    )
    return counts.crossJoin(duplicate_preview(photos)).crossJoin(last_scan(scans)).crossJoin(delete_tally(operations))


def directory_counts(photos: DataFrame) -> DataFrame:
    return photos.where(is_active()).groupBy("directory").agg(F.count("*").alias("n"))


def duplicate_summary(groups: DataFrame, members: DataFrame, decisions: DataFrame, photos: DataFrame) -> DataFrame:
    c = lambda e: F.count_if(F.expr(e))
    by = groups.agg(
        F.count("*").alias("groups"), c("kind = 'exact'").alias("exact"), c("kind = 'similar'").alias("similar"),
        c("status = 'pending'").alias("pending"), c("status = 'reviewed'").alias("reviewed"), c("status = 'dismissed'").alias("dismissed"),
    )
    rows = members.agg(F.count("*").alias("member_rows"))
    return by.crossJoin(rows).crossJoin(marked_remove(decisions, photos))


def marked_remove(decisions: DataFrame, photos: DataFrame) -> DataFrame:
    """Count and bytes of remove decisions, whatever the photo's status, one for each decision."""
    own = photos.select(F.col("id").alias("photo_id"), "size_bytes")
    return decisions.where("decision = 'remove'").join(own, "photo_id").agg(F.count("*").alias("marked_remove_count"), _total("size_bytes").alias("marked_remove_bytes"))


def ticks(progress: DataFrame) -> DataFrame:
    """Rates between successive ticks (who, at, seq, done): null on the first, at least a microsecond apart."""
    from pyspark.sql import Window

    w = Window.partitionBy("who").orderBy("at", "seq")
    seconds = F.greatest(F.col("at") - F.lag("at").over(w), F.lit(1e-6))
    return progress.select("who", "seq", ((F.col("done") - F.lag("done").over(w)) / seconds).alias("per_sec"))


def report(rows: DataFrame, by: str, limit: int, label: str) -> DataFrame:
    """A top-k of any statistics table, its label squeezed to one line."""
    from heliograph.functions.columns import collapse_space

    return rows.orderBy(F.desc(by), label).limit(limit).withColumn(label, collapse_space(label))


def client_sums(photos: DataFrame, selected: DataFrame) -> DataFrame:
    """(marked_bytes, selected_bytes): bytes of the marked active photos and of a selection (id)."""
    chosen = photos.join(selected.select("id", F.lit(True).alias("__chosen")).distinct(), "id", "left")
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("size_bytes"))), F.lit(0)).cast("long")
    return chosen.agg(total(is_active() & F.col("marked_for_deletion")).alias("marked_bytes"), total(F.col("__chosen")).alias("selected_bytes"))
