"""Browsing the library: filters, sorts, pages, facets, work-list, and what is derived from one page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions.columns import any_of, band, canonical_ext, hamming, month_label
from heliograph.schemas import CANONICAL, INFO_COLUMNS, LIST_COLUMNS

NO_CAMERA = ""


def is_active() -> Column:
    return F.col("status") == "active"


def is_visible() -> Column:
    """Facets and the folder tree show all but quarantined photos, missing ones too."""
    return F.col("status") != "quarantined"


def needs_location() -> Column:
    bare = F.col("latitude").isNull() & F.col("longitude").isNull()
    return bare | (F.col("latitude").isNotNull() & F.col("city").isNull())


def under(folder: str) -> Column:
    return F.col("path").startswith(folder.rstrip("/") + "/")


def expand_types(values: list[str]) -> list[str]:
    """Canonical names stand for all their spellings; other values pass, lower-cased."""
    out = []
    for v in (x.lower() for x in values):
        spellings = [ext for ext, name in CANONICAL.items() if name == v]
        out += [*spellings, v]
    return out


def camera_is(cameras: list[str]) -> Column:
    named = [c for c in cameras if c != NO_CAMERA]
    tests = [F.col("camera_model").isin(named)] if named else []
    if NO_CAMERA in cameras:
        tests.append(F.coalesce(F.col("camera_model"), F.lit("")) == "")
    return any_of(tests)


def name_matches(q: str) -> Column:
    """Case-insensitive search; % and _ in ``q`` are wildcards, a backslash is not an escape."""
    return F.col("filename").ilike("%" + q.replace("\\", "") + "%")


SORTS = {
    "captured_desc": lambda: [F.desc_nulls_last("captured_at"), F.desc("id")],
    "captured_asc": lambda: [F.asc_nulls_last("captured_at"), F.asc("id")],
    "name_asc": lambda: [F.asc("filename"), F.asc("id")],
    "name_desc": lambda: [F.desc("filename"), F.desc("id")],
    "size_desc": lambda: [F.desc("size_bytes"), F.desc("id")],
    "size_asc": lambda: [F.asc("size_bytes"), F.asc("id")],
    "added_desc": lambda: [F.desc("id")],
}


@dataclass(frozen=True)
class ListSpec:
    status: str | None = "active"
    folder: str | None = None
    types: tuple[str, ...] = ()
    cameras: tuple[str, ...] = ()
    q: str = ""
    sort: str = "captured_desc"
    limit: int = 100
    offset: int = 0


def listed(photos: DataFrame, spec: ListSpec) -> DataFrame:
    """The rows of a listing before order and page; every test but the name search reaches the scan."""
    out = photos
    if spec.status is not None:
        out = out.where(F.col("status") == spec.status)
    if spec.folder is not None:
        out = out.where(under(spec.folder))
    if spec.types:
        out = out.where(F.col("ext").isin(expand_types(list(spec.types))))
    if spec.cameras:
        out = out.where(camera_is(list(spec.cameras)))
    if spec.q:
        out = out.where(name_matches(spec.q))
    return out


def page(photos: DataFrame, spec: ListSpec) -> DataFrame:
    """One page: a top-k, never a full sort."""
    order = SORTS.get(spec.sort, SORTS["captured_desc"])()
    cols = [c for c in LIST_COLUMNS if c in photos.columns]
    return listed(photos, spec).orderBy(*order).select(cols).offset(spec.offset).limit(min(spec.limit, 1000))


def show_all(photos: DataFrame, spec: ListSpec) -> DataFrame:
    """Every row of a listing in its order, in place of paging through it; ``limit`` and ``offset`` have no part."""
    cols = [c for c in LIST_COLUMNS if c in photos.columns]
    return listed(photos, spec).orderBy(*SORTS.get(spec.sort, SORTS["captured_desc"])()).select(cols)


def total(photos: DataFrame, spec: ListSpec) -> DataFrame:
    return listed(photos, spec).agg(F.count("*").alias("total"))


def by_id(photos: DataFrame, photo_id: int) -> DataFrame:
    return photos.where(F.col("id") == photo_id).limit(1)


def by_path(photos: DataFrame, path: str) -> DataFrame:
    return photos.where(F.col("path") == path).limit(1)


def index_of_root(photos: DataFrame, root_id: int) -> DataFrame:
    return photos.where(F.col("root_id") == root_id).select("path", "id", "size_bytes", "mtime_ns", "status", "sha256")


def infos(photos: DataFrame) -> DataFrame:
    return photos.where(is_active()).select(INFO_COLUMNS)


def active_under(photos: DataFrame, folders: list[str]) -> DataFrame:
    """Active photos under any of the folders, by path; no folders, no photos."""
    return photos.where(is_active() & any_of([under(f) for f in folders])).orderBy("path")


def paths_under(photos: DataFrame, prefix: str) -> DataFrame:
    return photos.where(under(prefix)).select("path")


def type_facets(photos: DataFrame) -> DataFrame:
    return photos.where(is_visible()).groupBy(canonical_ext("ext").alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def camera_facets(photos: DataFrame) -> DataFrame:
    """Cameras by count; the bucket of photos without one comes last and only if it has any."""
    camera = F.coalesce("camera_model", F.lit(NO_CAMERA)).alias("camera")
    return photos.where(is_visible()).groupBy(camera).agg(F.count("*").alias("n")).orderBy(F.col("camera") == NO_CAMERA, F.desc("n"), "camera")


def marked_worklist(photos: DataFrame, decisions: DataFrame, collation: str | None = None) -> DataFrame:
    """Active photos that are marked or that a decision removes, by path; in the order of a ``collation`` such as UNICODE, else by code point."""
    removed = decisions.where("decision = 'remove'").select(F.col("photo_id").alias("id")).distinct().withColumn("__removed", F.lit(True))
    hit = photos.where(is_active()).join(removed, "id", "left").where(F.col("marked_for_deletion") | F.col("__removed"))
    return hit.drop("__removed").orderBy(collated("path", collation), "path")


def collated(text: str, collation: str | None) -> Column:
    """A text to sort by: accents and case as the collation orders them."""
    return F.collate(text, collation) if collation else F.col(text)


def keyset_page(photos: DataFrame, after_id: int, limit: int) -> DataFrame:
    """The next photos that need a location, by id."""
    return photos.where(is_active() & needs_location() & (F.col("id") > after_id)).orderBy("id").limit(limit)


def similar_to(photos: DataFrame, photo_id: int, phash: int, threshold: int = 6, limit: int = 12) -> DataFrame:
    """The nearest active photos that share a byte band with a probe, by distance."""
    probe = F.lit(phash).cast("long")
    shares = any_of([band("phash", i) == band(probe, i) for i in range(8)])
    near = photos.where(is_active() & F.col("phash").isNotNull() & (F.col("id") != photo_id) & shares)
    near = near.withColumn("distance", hamming("phash", probe)).where(F.col("distance") <= threshold)
    return near.orderBy("distance", "id").limit(min(limit, 50))


# -- derived from one page (at most 1,000 rows, ordered by its position rn) --------


def numbered(page_rows: DataFrame, sort: str) -> DataFrame:
    return page_rows.withColumn("rn", F.row_number().over(Window.orderBy(*SORTS[sort]())))


def section_key(by: str) -> Column:
    if by == "folder":
        return F.regexp_replace("path", "/[^/]*$", "")
    if by == "date":
        return month_label("captured_at")
    return F.coalesce("camera_model", F.lit("Unknown camera"))


def sections(rows: DataFrame, by: str) -> DataFrame:
    """Sections of a numbered page in first-seen order, with their photo ids in page order."""
    keyed = rows.groupBy(section_key(by).alias("section")).agg(F.min("rn").alias("first_rn"), F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("m"))
    return keyed.select("section", "first_rn", F.transform("m", lambda x: x["id"]).alias("ids")).orderBy("first_rn")


def filmstrip(rows: DataFrame, reach: int = 12) -> DataFrame:
    w = Window.orderBy("rn")
    return rows.select("id", F.collect_list("id").over(w.rowsBetween(-reach, reach)).alias("strip"), F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def selected_range(rows: DataFrame, anchor: int, click: int) -> DataFrame:
    """The run of a numbered page between two photos, both included."""
    ends = rows.where(F.col("id").isin(anchor, click)).agg(F.min("rn").alias("a"), F.max("rn").alias("b"))
    return rows.join(F.broadcast(ends), F.col("rn").between(F.col("a"), F.col("b"))).drop("a", "b")


def page_range(total_rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """X, Y and the number of pages of "X-Y of Z"."""
    t = F.col("total")
    return total_rows.select(
        "total", F.when(t > 0, offset + 1).otherwise(0).cast("long").alias("first"), F.least(t, F.lit(offset + limit)).alias("last"),
        F.greatest(F.lit(1), F.ceil(t / limit)).cast("long").alias("pages"),
    )
