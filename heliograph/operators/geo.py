"""The nearest known place of a pair of coordinates, and the location backfill."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.columns import haversine
from heliograph.operators.library import is_active, keyset_page, needs_location

KM_PER_DEGREE = 111.0


def nearest_place(points: DataFrame, gazetteer: DataFrame, max_km: float = 100.0) -> DataFrame:
    """``points`` (id, latitude, longitude) with city, region, country and distance of the nearest place within ``max_km``.

    Places are spread over the cells around them and points looked up in their own cell:
    an equality join on a grid whose cells are at least ``max_km`` high.  A cell's width
    grows with latitude; near the poles one row of cells goes all round.
    """
    step = max(max_km / KM_PER_DEGREE * 1.01, 0.05)
    row = lambda lat: F.floor((lat + 90) / step).cast("int")
    top = math.ceil(180 / step)
    # per row of cells: how many columns, narrow enough in number that a cell spans max_km at the row's far edge and the next
    edge = lambda r: F.least(F.lit(90.0), F.greatest(F.abs(r * step - 90), F.abs((r + 1) * step - 90)) + step)
    columns = lambda r: F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge(r))) / step)).cast("int")
    column = lambda lon, r: F.least(columns(r) - 1, F.floor((lon + 180) / 360 * columns(r)).cast("int"))
    good = lambda df: df.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    p = good(points).withColumn("r", row(F.col("latitude"))).withColumn("c", column(F.col("longitude"), F.col("r")))
    g = good(gazetteer).select("city", "region", "country", F.col("latitude").alias("g_lat"), F.col("longitude").alias("g_lon"))
    g = g.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), row(F.col("g_lat")) - 1), F.least(F.lit(top), row(F.col("g_lat")) + 1))))
    here = column(F.col("g_lon"), F.col("r"))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(here + d, columns(F.col("r")))))
    g = g.withColumn("c", F.explode(around))
    met = p.join(g, ["r", "c"]).withColumn("km", haversine("latitude", "longitude", "g_lat", "g_lon")).where(F.col("km") <= max_km)
    best = met.groupBy("id").agg(F.min(F.struct("km", "city", "region", "country")).alias("b"))
    rounded = F.bround("b.km", 1).cast("float")
    return points.join(best, "id", "left").select(*points.columns, "b.city", "b.region", "b.country", rounded.alias("place_distance_km"))


def backfill_page(photos: DataFrame, coordinates: DataFrame, after_id: int, limit: int) -> DataFrame:
    """(processed, updated, next_after_id, remaining) of one page; ``coordinates`` (id, latitude, longitude) are what the files say."""
    rows = keyset_page(photos, after_id, limit).select("id", "latitude")
    located = rows.join(coordinates.where("latitude is not null and longitude is not null").select("id", F.lit(True).alias("found")), "id", "left")
    one = located.agg(F.count("*").alias("processed"), F.count_if(F.col("latitude").isNotNull() | F.col("found")).alias("updated"), F.max("id").alias("last"))
    more = F.col("processed") == limit
    todo = photos.where(is_active() & needs_location()).select("id")
    left = todo.join(F.broadcast(one), F.col("id") > F.col("last")).agg(F.count("*").alias("left"))
    return one.crossJoin(left).select("processed", "updated", F.when(more, F.col("last")).alias("next_after_id"), F.when(more, F.col("left")).otherwise(0).cast("long").alias("remaining"))


def backfilled(photos: DataFrame, coordinates: DataFrame, gazetteer: DataFrame, after_id: int, limit: int, max_km: float = 100.0) -> DataFrame:
    """The rows of one page as they become: id, latitude, longitude, city, region, country, place_distance_km.

    A photo without coordinates takes those that its file has, if any (``coordinates``: id,
    latitude, longitude).  Every located photo of the page gets the nearest place within
    ``max_km``; one that is further from all of them has none, whatever it had, and so is
    asked for again.
    """
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    rows = keyset_page(photos, after_id, limit).withColumn("known", has)
    read = coordinates.where(has).select("id", F.col("latitude").alias("new_lat"), F.col("longitude").alias("new_lon"))
    own = rows.join(read, "id", "left")
    at = lambda old, new: F.when(F.col("known"), F.col(old)).otherwise(F.coalesce(new, old))
    points = own.where(F.col("known") | F.col("new_lat").isNotNull()).select("id", at("latitude", "new_lat").alias("latitude"), at("longitude", "new_lon").alias("longitude"))
    return nearest_place(points, gazetteer, max_km)


def apply_backfill(photos: DataFrame, page: DataFrame) -> DataFrame:
    """``photos`` with a page's coordinates and places."""
    fields = ("latitude", "longitude", "city", "region", "country", "place_distance_km")
    hit = page.select("id", F.lit(True).alias("__hit"), *(F.col(f).alias(f"__{f}") for f in fields))
    both = photos.join(hit, "id", "left")
    return both.withColumns({f: F.when(F.col("__hit"), F.col(f"__{f}").cast(photos.schema[f].dataType)).otherwise(F.col(f)) for f in fields}).select(photos.columns)
