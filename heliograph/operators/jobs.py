"""Scan roots, scans and other jobs: small tables, small transitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.folders import nested_root
from heliograph.schemas import RUNNING, Conflict, NotFound, ValidationFailed


def add_root(roots: DataFrame, path: str) -> DataFrame:
    """A new enabled root, unless it equals, contains or lies in one that is there."""
    clean = path.rstrip("/")
    if not clean.startswith("/"):
        raise ValidationFailed("a root is an absolute path")
    if other := nested_root([r["path"] for r in roots.select("path").collect()], clean):
        raise Conflict(f"{clean} overlaps {other}")
    top = roots.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = top.select((F.col("top") + 1).cast("int").alias("id"), F.lit(clean).alias("path"), F.lit(True).alias("enabled"))
    return roots.select("id", "path", "enabled").unionByName(new)


def set_enabled(roots: DataFrame, root_id: int, enabled: bool) -> DataFrame:
    if not roots.where(F.col("id") == root_id).limit(1).count():
        raise NotFound(f"root {root_id}")
    return roots.withColumn("enabled", F.when(F.col("id") == root_id, F.lit(enabled)).otherwise(F.col("enabled")))


def remove_root(roots: DataFrame, photos: DataFrame, root_id: int) -> tuple[DataFrame, DataFrame]:
    """The root and all its photos go."""
    return roots.where(F.col("id") != root_id), photos.where(F.col("root_id").isNull() | (F.col("root_id") != root_id))


def roots_of(roots: DataFrame, scan_root_ids: list[int] | None) -> DataFrame:
    """The roots that a scan names, or all enabled ones."""
    return roots.where("enabled") if scan_root_ids is None else roots.where(F.col("id").isin(scan_root_ids))


def recent(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(limit)


def is_running(jobs: DataFrame) -> bool:
    return not jobs.where(F.col("status").isin(*RUNNING)).isEmpty()


def started(jobs: DataFrame, job_id: int) -> DataFrame:
    return jobs.withColumns({"started_at": F.when(F.col("id") == job_id, F.current_timestamp()).otherwise(F.col("started_at")), "status": F.when(F.col("id") == job_id, "running").otherwise(F.col("status"))})


def finished(jobs: DataFrame, job_id: int, status: str) -> DataFrame:
    return jobs.withColumns({"finished_at": F.when(F.col("id") == job_id, F.current_timestamp()).otherwise(F.col("finished_at")), "status": F.when(F.col("id") == job_id, status).otherwise(F.col("status"))})


def errors_page(errors: DataFrame, scan_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    return errors.where(F.col("scan_id") == scan_id).orderBy("id").offset(offset).limit(min(limit, 500))


def without_scan(scans: DataFrame, errors: DataFrame, scan_id: int) -> tuple[DataFrame, DataFrame]:
    return scans.where(F.col("id") != scan_id), errors.where(F.col("scan_id") != scan_id)


def distinct_list(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values of each key in one text, in order."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("all_values"))


def valid_destination(entry: str) -> bool:
    """Whether a typed folder has only sensible segments: none empty, hidden, with a colon or with spaces at its ends."""
    return all(s and not s.startswith(".") and ":" not in s and s == s.strip() for s in re.split("/", entry.strip("/")))
