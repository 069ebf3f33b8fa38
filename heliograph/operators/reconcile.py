"""Reconciling what a scan found with what the catalog knows: pure functions from state to state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.columns import basename, dirname, extension, mime_of
from heliograph.operators.ranks import numbered
from heliograph.schemas import RUNNING
from heliograph.storage import Scratch


def classify(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, id, class, status): unchanged, changed, added, unreadable or unseen, by one full outer join on the path.

    ``disk`` has path, size_bytes, mtime_ns and may have error; a file that is there but
    unreadable counts as seen and leaves its row alone.
    """
    error = F.col("error") if "error" in disk.columns else F.lit(None).cast("string")
    d = disk.select("path", F.col("size_bytes").alias("d_size"), F.col("mtime_ns").alias("d_mtime"), error.alias("error"), F.lit(True).alias("seen"))
    i = index.select("path", "id", F.col("size_bytes").alias("i_size"), F.col("mtime_ns").alias("i_mtime"), "status")
    same = (F.col("status") == "active") & (F.col("d_size") == F.col("i_size")) & (F.col("d_mtime") == F.col("i_mtime"))
    kind = (
        F.when(F.col("seen").isNull(), "unseen").when(F.col("error").isNotNull(), "unreadable").when(F.col("id").isNull(), "added").when(same, "unchanged").otherwise("changed")
    )
    return d.join(i, "path", "full_outer").select("path", "id", kind.alias("class"), "status")


def move_pairs(vanished: DataFrame, added: DataFrame) -> DataFrame:
    """(old_id, old_path, new_path): vanished rows paired one to one with added files of the same content.

    Any pairing of equal content is as good; this one is fixed: vanished by (root_id, id), added by path, last first.
    Ranks are distributed, so one content with a million files is no task's alone.
    """
    scratch = Scratch(vanished.sparkSession, "pairs")
    v = scratch.table(vanished.where(F.col("sha256").isNotNull()).select("sha256", "root_id", F.col("id").alias("old_id"), F.col("path").alias("old_path")), "vanished")
    a = scratch.table(added.where(F.col("sha256").isNotNull()).select("sha256", F.col("path").alias("new_path")), "added")
    one, other = numbered(v, ["sha256"], ["root_id", "old_id"], "k"), numbered(a, ["sha256"], [F.desc("new_path")], "k")
    return one.join(other, ["sha256", "k"]).select("old_id", "old_path", "new_path")


def missing(classes: DataFrame, moves: DataFrame) -> DataFrame:
    """Active rows that were not seen and did not move."""
    return classes.where("class = 'unseen' AND status = 'active'").join(moves.select(F.col("old_id").alias("id")), "id", "left_anti").select("id", "path")


def counters(classes: DataFrame, moves: DataFrame) -> DataFrame:
    """The scan's eight counters in one row, when it has ended; a move is not an addition."""
    n = lambda kind: F.count_if(F.col("class") == kind)
    base = classes.agg(
        F.count_if(F.col("class") != "unseen").alias("files_found"), F.count_if(F.col("class") != "unseen").alias("files_processed"), n("added").alias("added"), n("changed").alias("files_changed"), n("unchanged").alias("files_unchanged"), n("unreadable").alias("error_count"),
    )
    moved, gone = moves.agg(F.count("*").alias("files_moved")), missing(classes, moves).agg(F.count("*").alias("files_missing"))
    return base.crossJoin(moved).crossJoin(gone).select("files_found", "files_processed", (F.col("added") - F.col("files_moved")).alias("files_added"), "files_changed", "files_unchanged", "files_missing", "files_moved", "error_count")


def changed_anything(row) -> bool:
    return any(row[c] > 0 for c in ("files_added", "files_changed", "files_missing", "files_moved"))


def mark_missing(photos: DataFrame, gone: DataFrame) -> DataFrame:
    hit = gone.select("id", F.lit(True).alias("__gone"))
    return photos.join(hit, "id", "left").withColumn("status", F.when(F.col("__gone"), "missing").otherwise(F.col("status"))).drop("__gone")


def apply_moves(photos: DataFrame, moves: DataFrame) -> DataFrame:
    """Moved rows keep their id and take the new path; the rows that the new paths had are gone."""
    taken = photos.join(moves.select(F.col("new_path").alias("path")), "path", "left_anti")
    hit = moves.select(F.col("old_id").alias("id"), "new_path")
    rows = taken.join(hit, "id", "left")
    path = F.coalesce("new_path", "path")
    new = {"path": path, "directory": dirname(path), "filename": basename(path), "status": F.when(F.col("new_path").isNotNull(), "active").otherwise(F.col("status"))}
    return rows.withColumns({k: v for k, v in new.items() if k in rows.columns}).drop("new_path").select(photos.columns)


#: What a scan writes of a file, apart from its place in the library.
WRITTEN = (
    "size_bytes", "mtime_ns", "sha256", "width", "height", "captured_at", "camera_make", "camera_model", "latitude", "longitude",
    "city", "region", "country", "place_distance_km", "exif", "phash", "last_error", "status",
)


def upsert(photos: DataFrame, processed: DataFrame) -> DataFrame:
    """``photos`` after a scan: by path, all fields of known rows are overwritten and unknown rows are added after the largest id.

    ``processed`` has path, root_id and what was read of each usable file; a field that it
    lacks becomes null, as the file no longer says it, and every row written is active.
    A known row keeps its id and root.  New rows are numbered by the hash of their path in
    4,096 buckets, so no task sorts them all.
    """
    kinds = {f.name: f.dataType for f in photos.schema.fields}
    fields = [c for c in WRITTEN if c in kinds]
    value = lambda c: F.lit("active") if c == "status" else (F.col(c) if c in processed.columns else F.lit(None))
    p = processed.select("path", F.lit(True).alias("__seen"), F.col("root_id").alias("n_root_id"), *(value(c).cast(kinds[c]).alias(f"n_{c}") for c in fields))
    both = photos.join(p, "path", "full_outer")
    known = both.where("id is not null").withColumns({c: F.when(F.col("__seen"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in fields}).select(photos.columns)
    fresh = both.where("id is null").withColumn("__b", F.pmod(F.hash("path"), F.lit(4096)))
    sizes = fresh.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    top = photos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("path"))
    added = fresh.withColumn("__rn", rn).join(F.broadcast(before), "__b").crossJoin(F.broadcast(top))
    new = {c: F.col(f"n_{c}") for c in (*fields, "root_id") if c in kinds} | {"id": (F.col("top") + F.col("__before") + F.col("__rn")).cast(kinds["id"])}
    own = {"directory": dirname("path"), "filename": basename("path"), "ext": extension("path"), "mime": mime_of(extension("path"))}
    added = added.withColumns(new | {k: v for k, v in own.items() if k in kinds})
    return known.unionByName(added.select(photos.columns))


def touched_ids(photos: DataFrame, ids: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids known directly and ids of touched paths, once each."""
    return ids.select("id").unionByName(photos.join(paths.select("path"), "path", "left_semi").select("id")).distinct()


def split_errors(processed: DataFrame, scan_id: int) -> tuple[DataFrame, DataFrame]:
    """(usable rows, scan errors): a row with a hash is usable even if it could not be decoded."""
    errors = processed.where(F.col("error").isNotNull()).select(F.lit(scan_id).cast("long").alias("scan_id"), "path", "error")
    return processed.where(F.col("sha256").isNotNull()), errors


def with_generated(photos: DataFrame) -> DataFrame:
    """Columns that follow from the path and the hash."""
    from heliograph.functions.columns import band

    out = photos.withColumns({"directory": dirname("path"), "filename": basename("path"), "ext": extension("path")}).withColumn("mime", mime_of("ext"))
    return out.withColumns({f"phash_b{i}": band("phash", i).cast("short") for i in range(8)}) if "phash" in photos.columns else out


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that a crash left waiting or running have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*RUNNING), "failed").otherwise(F.col("status")))
