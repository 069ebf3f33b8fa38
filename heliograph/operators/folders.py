"""The folder tree and other questions about path prefixes.

Prefix joins are rewritten: a path is exploded into its ancestors and joined by
equality, so no plan holds a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.columns import ancestors, basename, strip_date_bucket
from heliograph.operators.library import is_active, is_visible


def folder_tree(photos: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, parent, name, depth, photo_count, direct_count, has_children) of all folders at or below a root.

    Counts are first made per directory, so what is exploded are directories, not photos.
    """
    direct = photos.where(is_visible()).groupBy("directory").agg(F.count("*").alias("n"))
    up = direct.select("directory", "n", F.explode(ancestors("directory")).alias("path"))
    own = roots.select(F.regexp_replace("path", "/+$", "").alias("root")).distinct()
    rooted = up.join(own, F.col("path") == F.col("root")).groupBy("directory").agg(F.min(F.length("root")).alias("root_len"))
    inside = up.join(rooted, "directory").where(F.length("path") >= F.col("root_len"))
    counts = inside.groupBy("path").agg(
        F.sum("n").alias("photo_count"), F.sum(F.when(F.col("directory") == F.col("path"), F.col("n")).otherwise(0)).alias("direct_count"), F.min("root_len").alias("root_len"),
        F.bool_or(F.col("directory") != F.col("path")).alias("has_children"),
    )
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    depth = slashes(F.col("path")) - slashes(F.expr("substring(path, 1, root_len)"))
    parent = F.when(F.length("path") > F.col("root_len"), F.regexp_replace("path", "/[^/]*$", ""))
    return counts.select("path", parent.alias("parent"), basename("path").alias("name"), depth.alias("depth"), "photo_count", "direct_count", "has_children")


def library_layout(photos: DataFrame) -> DataFrame:
    """Where the active photos are, folders by date folded into what holds them, largest first."""
    per = photos.where(is_active()).groupBy("directory").agg(F.count("*").alias("n"))
    return per.groupBy(strip_date_bucket("directory").alias("location")).agg(F.sum("n").alias("photos")).orderBy(F.desc("photos"), "location")


def splits_library(photos: DataFrame, destination: str) -> DataFrame:
    """Whether a destination is another place than the one that holds most photos."""
    return library_layout(photos).limit(1).select((F.col("location") != destination.rstrip("/")).alias("splits"))


def top_level(folders: DataFrame) -> DataFrame:
    """(folder) without trailing slashes, once each, none that lies below another."""
    own = folders.select(F.regexp_replace("folder", "/+$", "").alias("folder")).distinct()
    above = own.select("folder", F.explode(ancestors("folder")).alias("up")).where("up <> folder")
    nested = above.join(own.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return own.join(nested, "folder", "left_anti")


def root_of_path(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root_id): the longest root at or above each path, null if none is."""
    up = paths.select("path", F.explode(ancestors("path")).alias("root"))
    own = roots.select(F.col("id").alias("root_id"), F.regexp_replace("path", "/+$", "").alias("root"))
    best = up.join(own, "root").groupBy("path").agg(F.max_by("root_id", F.length("root")).alias("root_id"))
    return paths.select("path").distinct().join(best, "path", "left")


def visible_rows(tree: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows of the tree whose every ancestor in the tree is expanded."""
    up = tree.select("path", F.explode(ancestors("path")).alias("up")).where("up <> path")
    inside = up.join(tree.select(F.col("path").alias("up")), "up", "left_semi")
    hidden = inside.join(expanded.select(F.col("path").alias("up")), "up", "left_anti").select("path").distinct()
    return tree.join(hidden, "path", "left_anti")


def nested_root(roots: list[str], new: str) -> str | None:
    """The root that equals, contains or lies in a new one, if any."""
    clean = new.rstrip("/")
    for r in (x.rstrip("/") for x in roots):
        if r == clean or clean.startswith(f"{r}/") or r.startswith(f"{clean}/"):
            return r
    return None


def layout_total(layout: DataFrame) -> DataFrame:
    """(locations, total): how many places a layout has and how many photos in all."""
    return layout.agg(F.count("*").alias("locations"), F.coalesce(F.sum("photos"), F.lit(0)).cast("long").alias("total"))
