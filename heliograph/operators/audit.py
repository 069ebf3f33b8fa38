"""Marks, quarantine and the audit log as pure state transitions; no file is touched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators.groups import fully_covered
from heliograph.schemas import Conflict, ValidationFailed


def _flagged(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return photos.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def set_marked(photos: DataFrame, ids: DataFrame, marked: bool) -> DataFrame:
    hit = F.col("__hit") & (F.col("status") == "active")
    return _flagged(photos, ids).withColumn("marked_for_deletion", F.when(hit, F.lit(marked)).otherwise(F.col("marked_for_deletion"))).drop("__hit")


def marked_count(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return photos.where("status = 'active'").join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("affected"))


def outcome(allowed: str) -> Column:
    """Per-item result of a transition that starts from one status."""
    return F.when(F.col("status") == allowed, "ok").otherwise(F.concat(F.lit("status is "), F.col("status")))


def results(photos: DataFrame, ids: DataFrame, allowed: str) -> DataFrame:
    """(id, result): ok, what status forbids it, or not found."""
    rows = ids.select("id").distinct().join(photos.select("id", "status"), "id", "left")
    return rows.select("id", F.coalesce(outcome(allowed), F.lit("not found")).alias("result"))


def batch_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("result") == "ok").alias("succeeded"), F.count_if(F.col("result") != "ok").alias("failed"))


def quarantine(photos: DataFrame, members: DataFrame, ids: DataFrame, force: bool = False) -> DataFrame:
    """Active photos of ``ids`` are quarantined and lose their mark; refused if that takes every copy of a group."""
    if not force and fully_covered(members, photos, ids).limit(1).count():
        raise Conflict("every active copy of a group would go")
    hit = F.col("__hit") & (F.col("status") == "active")
    return _flagged(photos, ids).withColumns(
        {"marked_for_deletion": F.when(hit, F.lit(False)).otherwise(F.col("marked_for_deletion")), "status": F.when(hit, "quarantined").otherwise(F.col("status"))}
    ).drop("__hit")


def restore(photos: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("__hit") & (F.col("status") == "quarantined")
    return _flagged(photos, ids).withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).drop("__hit")


def delete_permanently(photos: DataFrame, operations: DataFrame, ids: DataFrame, confirm: bool) -> tuple[DataFrame, DataFrame]:
    """(photos left, audit log with the deletions; rows of a deleted photo lose their photo_id)."""
    if not confirm:
        raise ValidationFailed("deleting needs a confirmation")
    gone = photos.where("status = 'quarantined'").join(ids.select("id").distinct(), "id", "left_semi")
    left = photos.join(gone.select("id"), "id", "left_anti")
    log = operations.join(gone.select(F.col("id").alias("photo_id"), F.lit(True).alias("__gone")), "photo_id", "left")
    log = log.withColumn("photo_id", F.when(F.col("__gone"), F.lit(None)).otherwise(F.col("photo_id"))).drop("__gone").select(operations.columns)
    rows = gone.select(F.lit(None).cast("long").alias("photo_id"), F.lit("delete").alias("op"), F.col("path").alias("src_path"), "size_bytes")
    return left, log.unionByName(rows, allowMissingColumns=True)


def reset_history(operations: DataFrame) -> DataFrame:
    return operations.where(F.col("photo_id").isNotNull())


def audit_page(operations: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return operations.orderBy(F.desc("id")).offset(offset).limit(min(limit, 200))


def latest_quarantine(operations: DataFrame) -> DataFrame:
    """(photo_id, id, src_path): the last quarantine of each photo."""
    own = operations.where("op = 'quarantine' AND photo_id IS NOT NULL")
    return own.groupBy("photo_id").agg(F.max_by(F.struct("id", "src_path"), "id").alias("o")).select("photo_id", "o.id", "o.src_path")


def append(operations: DataFrame, path: str) -> None:
    """Add rows to the audit log; it only ever grows."""
    operations.write.mode("append").parquet(path)


def cascade(photos: DataFrame, members: DataFrame, decisions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memberships and decisions of photos that are gone go; keepers that are gone become null."""
    own = photos.select(F.col("id").alias("photo_id")).distinct()
    kept = groups.join(own.select(F.col("photo_id").alias("keeper_photo_id"), F.lit(True).alias("__there")), "keeper_photo_id", "left")
    kept = kept.withColumn("keeper_photo_id", F.when(F.col("__there"), F.col("keeper_photo_id"))).drop("__there").select(groups.columns)
    return members.join(own, "photo_id", "left_semi"), decisions.join(own, "photo_id", "left_semi"), kept


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Spark has no constraints: fail if a key occurs twice."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise Conflict(f"{', '.join(keys)} must be unique")
