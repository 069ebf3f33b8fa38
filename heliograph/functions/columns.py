"""Scalar functions of the catalog as Column expressions; all run in the JVM."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.schemas import CANONICAL, DEFAULT_MIME, MIME


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, key), default)


# -- paths and strings ---------------------------------------------------------


def dirname(path) -> Column:
    return F.regexp_replace(_c(path), "/[^/]*$", "")


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path) -> Column:
    """Lower-case, without the dot; empty where the file name has none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]*)$", 1))


def mime_of(ext) -> Column:
    return lookup(MIME, _c(ext), F.lit(DEFAULT_MIME))


def canonical_ext(ext) -> Column:
    return lookup(CANONICAL, _c(ext), _c(ext))


def strip_nul(s) -> Column:
    return F.replace(_c(s), F.lit("\0"), F.lit(""))


def clean_text(s) -> Column:
    """Without NULs and outer white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(strip_nul(s), r"(?U)^\s+|\s+$", ""), F.lit(""))


def sanitize_segment(name, fallback: str = "Unknown camera", width: int = 80) -> Column:
    """A folder name: slashes become hyphens, NULs, outer space and leading dots go, at most ``width`` characters."""
    s = F.btrim(strip_nul(F.replace(_c(name), F.lit("/"), F.lit("-"))))
    s = F.btrim(F.substring(F.regexp_replace(s, r"^\.+", ""), 1, width))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def with_suffix(name, n) -> Column:
    """``name`` with _NN before its extension; numbers over 99 keep their digits."""
    n = _c(n).cast("string")
    number = F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    stem = F.regexp_replace(_c(name), r"(?<=.)\.[^./]*$", "")
    return F.concat(stem, F.lit("_"), number, F.substr(_c(name), F.length(stem) + 1))


def strip_date_bucket(directory) -> Column:
    """A directory without a trailing /YYYY/MM or /Undated."""
    return F.regexp_replace(_c(directory), r"/([0-9]{4}/[0-9]{2}|Undated)$", "")


def short_path(path) -> Column:
    parts = F.filter(F.split(_c(path), "/"), lambda x: x != "")
    return F.when(F.size(parts) > 3, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(_c(path))


def collapse_space(s, width: int = 90) -> Column:
    return F.left(F.regexp_replace(_c(s), r"\s+", " "), F.lit(width))


def quarantine_slot(root: str, path) -> Column:
    return F.concat(F.lit(root.rstrip("/")), _c(path))


def thumbnail_path(root: str, sha, size: int) -> Column:
    s = _c(sha)
    return F.concat_ws("/", F.lit(root), F.lit(str(size)), F.substring(s, 1, 2), F.concat(s, F.lit(".webp")))


def ancestors(directory) -> Column:
    """The directory and everything above it, as an array of paths; the root itself is not one."""
    parts = F.filter(F.split(_c(directory), "/"), lambda x: x != "")
    upto = F.sequence(F.lit(1), F.size(parts))
    paths = F.transform(upto, lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))


UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(n, largest: str = "TB") -> Column:
    """1024 steps up to the unit ``largest``; whole numbers from 100 on or for plain bytes, else one decimal."""
    n = _c(n).cast("double")
    units = UNITS[: UNITS.index(largest) + 1]
    step = sum((F.when(n >= 1024.0**k, 1).otherwise(0) for k in range(1, len(units))), F.lit(0))
    value = n / F.pow(F.lit(1024.0), step)
    whole = (step == 0) | (value >= 100)
    text = F.when(whole, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), step + 1))


def format_count(n) -> Column:
    return F.format_number(_c(n), 0)


def format_place(city, region, country, distance_km, near_km: float = 5.0) -> Column:
    qualifier = F.when(_c(country) == "US", _c(region)).otherwise(F.coalesce(_c(region), _c(country)))
    name = F.concat_ws(", ", _c(city), qualifier)
    return F.when(_c(city).isNotNull(), F.when(_c(distance_km) > near_km, F.concat(F.lit("near "), name)).otherwise(name))


def format_coordinates(lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    side = lambda v, a, b: F.when(v >= 0, F.lit(a)).otherwise(F.lit(b))
    return F.format_string("%.5f° %s, %.5f° %s", F.abs(lat), side(lat, "N", "S"), F.abs(lon), side(lon, "E", "W"))


def map_url(lat, lon) -> Column:
    lat, lon = _c(lat).cast("string"), _c(lon).cast("string")
    return F.concat(F.lit("https://www.openstreetmap.org/?mlat="), lat, F.lit("&mlon="), lon, F.lit("#map=15/"), lat, F.lit("/"), lon)


def section_title(directory) -> Column:
    """The last segment of a directory."""
    return F.element_at(F.split(_c(directory), "/"), -1)


def short_hash(sha) -> Column:
    return F.left(_c(sha), F.lit(12))


def type_label(ext) -> Column:
    return F.upper(_c(ext))


# -- dates -----------------------------------------------------------------------


def exif_datetime(s) -> Column:
    return F.try_to_timestamp(F.btrim(_c(s)), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def captured(original, fallback) -> Column:
    return F.coalesce(exif_datetime(original), exif_datetime(fallback))


def date_folder(at) -> Column:
    return F.coalesce(F.date_format(_c(at), "yyyy/MM"), F.lit("Undated"))


def dated_name(at, filename) -> Column:
    name = _c(filename)
    suffix = F.regexp_extract(name, r".(\.[^./]*)$", 1)
    return F.when(_c(at).isNull(), name).otherwise(F.concat(F.date_format(_c(at), "yyyy-MM-dd_HHmmss"), F.lower(suffix)))


def month_label(at) -> Column:
    return F.coalesce(F.date_format(_c(at), "MMMM yyyy"), F.lit("No capture date"))


def short_date(at) -> Column:
    return F.coalesce(F.date_format(_c(at), "MMM d, yyyy"), F.lit("—"))


# -- bits ------------------------------------------------------------------------


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def band(phash, i: int) -> Column:
    return F.shiftright(_c(phash), 8 * i).bitwiseAND(F.lit(255)).cast("int")


def bands(phash) -> Column:
    """The 8 byte bands as an array of (band, value)."""
    return F.array(*(F.struct(F.lit(i).alias("band"), band(phash, i).alias("value")) for i in range(8)))


def similarity_pct(distance) -> Column:
    """Share of equal bits in percent, halves to even."""
    return F.bround((64 - _c(distance)) / F.lit(64.0) * 100, 0).cast("int")


def progress_pct(done, found) -> Column:
    share = F.floor(_c(done) * 100.0 / F.nullif(_c(found), F.lit(0)) + 0.5)
    return F.when(share.isNull(), 0).otherwise(F.least(F.lit(100), share)).cast("int")


# -- geography -------------------------------------------------------------------

EARTH_KM = 6371.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat, dlon = a2 - a1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def dms_to_decimal(dms, ref, negative: str) -> Column:
    """[degrees, minutes, seconds] to a signed decimal; null unless there are exactly three numbers."""
    d = _c(dms)
    value = F.get(d, F.lit(0)) + F.get(d, F.lit(1)) / 60 + F.get(d, F.lit(2)) / 3600
    return F.when(F.size(d) == 3, F.when(F.upper(F.btrim(_c(ref))) == negative, -value).otherwise(value))


def coordinates(lat, lon) -> Column:
    """(lat, lon) if both are there and in range, else a struct of nulls."""
    good = _c(lat).between(-90, 90) & _c(lon).between(-180, 180)
    return F.struct(F.when(good, _c(lat)).alias("latitude"), F.when(good, _c(lon)).alias("longitude"))


# -- JSON ------------------------------------------------------------------------


def iso_label(exif) -> Column:
    """``ISO n`` of the EXIF object if the field is a number or a string."""
    v = F.try_parse_json(_c(exif))
    kind = F.schema_of_variant(F.try_variant_get(v, "$.ISOSpeedRatings", "variant"))
    value = F.try_variant_get(v, "$.ISOSpeedRatings", "string")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|STRING)$"), F.concat(F.lit("ISO "), value))


ORGANIZE_PARAMS = "struct<folders: array<string>, destination: string, mode: string, rename: boolean, skip_duplicates: boolean>"


def organize_params(text) -> Column:
    """A stored spec; rename defaults to false, skip_duplicates to true."""
    p = F.from_json(_c(text), ORGANIZE_PARAMS)
    return F.struct(
        p["folders"].alias("folders"), p["destination"].alias("destination"), p["mode"].alias("mode"),
        F.coalesce(p["rename"], F.lit(False)).alias("rename"), F.coalesce(p["skip_duplicates"], F.lit(True)).alias("skip_duplicates"),
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
