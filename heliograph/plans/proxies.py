"""The catalog's tables as views over the driver's tables, built alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.columns import dirname, mime_of
from heliograph.operators import groups as G


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def photos(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "jpeg", "png", "heic", "tif"))), (i % 5 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), i.cast("string"), F.lit("."), ext)
    path = F.concat(F.lit("/lib/"), "lang", F.lit("/"), "source", F.lit("/"), name)
    located = i % 4 != 0
    camera = F.when(i % 7 == 0, F.lit(None)).when(i % 17 == 0, F.lit("")).otherwise(F.col("lang"))
    exif = F.when(i % 4 == 0, F.concat(F.lit('{"ISOSpeedRatings": '), (i % 32 * 100).cast("string"), F.lit("}"))).when(i % 4 == 1, F.lit('{"ISOSpeedRatings": "auto"}')).when(i % 4 == 2, F.lit('{"ISOSpeedRatings": [100]}')).otherwise(F.lit('{"Make": "x"}'))
    return read(spark, d, "documents").select(
        i.alias("id"),
        F.expr("CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END").alias("root_id"),
        path.alias("path"),
        dirname(path).alias("directory"),
        name.alias("filename"),
        ext.alias("ext"),
        mime_of(ext).alias("mime"),
        F.col("n_chars").alias("size_bytes"),
        (i * 1000003).alias("mtime_ns"),
        (i % 40 + 1).cast("int").alias("width"),
        (i % 30 + 1).cast("int").alias("height"),
        F.when(i % 9 != 0, F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)")).alias("captured_at"),
        camera.alias("camera_model"),
        F.when(located, (i * 37 % 18000) / F.lit(100.0) - 90).alias("latitude"),
        F.when(located, (i * 73 % 36000) / F.lit(100.0) - 180).alias("longitude"),
        F.when(located & (i % 6 != 0), F.concat(F.lit("City"), (i % 10).cast("string"))).alias("city"),
        F.when(i % 3 != 0, F.concat(F.lit("R"), (i % 5).cast("string"))).alias("region"),
        F.element_at(F.array(*map(F.lit, ("US", "DE", "JP"))), (i % 3 + 1).cast("int")).alias("country"),
        (i % 12).cast("float").alias("place_distance_km"),
        exif.alias("exif"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.when(i % 11 == 0, "quarantined").when(i % 13 == 0, "missing").otherwise("active").alias("status"),
        (i % 19 == 0).alias("marked_for_deletion"),
    )


PHOTOS = """photos AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM (
SELECT doc_id AS id, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS root_id,
 '/lib/' || lang || '/' || source || '/doc_' || doc_id || '.' || ext AS path, 'doc_' || doc_id || '.' || ext AS filename, ext,
 CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'heic' THEN 'image/heic' ELSE 'image/tiff' END AS mime,
 n_chars AS size_bytes, doc_id * 1000003 AS mtime_ns, CAST(doc_id % 40 + 1 AS INT) AS width, CAST(doc_id % 30 + 1 AS INT) AS height,
 CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2020-01-01 00:00:00' + to_hours(doc_id) END AS captured_at,
 CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE lang END AS camera_model,
 CASE WHEN doc_id % 4 <> 0 THEN (doc_id * 37 % 18000) / 100.0::DOUBLE - 90 END AS latitude,
 CASE WHEN doc_id % 4 <> 0 THEN (doc_id * 73 % 36000) / 100.0::DOUBLE - 180 END AS longitude,
 CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 <> 0 THEN 'City' || (doc_id % 10) END AS city,
 CASE WHEN doc_id % 3 <> 0 THEN 'R' || (doc_id % 5) END AS region, ['US', 'DE', 'JP'][doc_id % 3 + 1] AS country,
 CAST(doc_id % 12 AS FLOAT) AS place_distance_km,
 CASE doc_id % 4 WHEN 0 THEN '{"ISOSpeedRatings": ' || (doc_id % 32 * 100) || '}' WHEN 1 THEN '{"ISOSpeedRatings": "auto"}'
  WHEN 2 THEN '{"ISOSpeedRatings": [100]}' ELSE '{"Make": "x"}' END AS exif,
 sha256(text) AS sha256, CASE WHEN doc_id % 11 = 0 THEN 'quarantined' WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'active' END AS status,
 doc_id % 19 = 0 AS marked_for_deletion
FROM (SELECT *, ['jpg', 'jpeg', 'png', 'heic', 'tif'][doc_id % 5 + 1] AS ext FROM documents)))"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """(id, phash): a 64-bit SimHash of a text's distinct lower-cased tokens, standing in for a picture's hash."""
    docs, cores = read(spark, d, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # one small file: let all cores hash its tokens
        docs = docs.repartition(cores, "doc_id")
    tokens = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("t"))
    h = tokens.select("id", F.expr("cast(conv(substr(md5(t), 1, 16), 16, -10) as bigint)").alias("h"))
    # three counters of 21 bits share a long, so that the aggregate's code stays small enough to compile
    one = lambda i: F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) if i < 64 else F.lit(0).cast("long")
    packed = [one(i) + F.shiftleft(one(i + 1), 21) + F.shiftleft(one(i + 2), 42) for i in range(0, 64, 3)]
    sums = h.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{3 * i}") for i, x in enumerate(packed)))
    held = sums.select("id", "n", F.array(*(f"s{i}" for i in range(0, 64, 3))).alias("s"))
    bit = "if((shiftrightunsigned(s[cast(i div 3 as int)], 21 * (i % 3)) & 2097151L) * 2 > n, shiftleft(1L, i), 0L)"
    return held.select("id", F.expr(f"aggregate(sequence(0, 63), 0L, (a, i) -> a | {bit})").alias("phash"))


_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
HASHES = f"""hashes AS (SELECT id, CASE WHEN u > 9223372036854775807 THEN CAST(u - 18446744073709551616 AS BIGINT) ELSE CAST(u AS BIGINT) END AS phash FROM (
SELECT id, {_BITS} AS u FROM (SELECT id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM
 (SELECT doc_id AS id, unnest(list_distinct(string_split(lower(text), ' '))) AS t FROM documents)) GROUP BY id))"""


def hashed_photos(spark: SparkSession, d: str) -> DataFrame:
    return photos(spark, d).join(hashes(spark, d).hint("merge"), "id")  # a row for each photo is nothing to broadcast


HASHED = f"{PHOTOS}, {HASHES}, hashed AS (SELECT * FROM photos JOIN hashes USING (id))"


def roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "/lib/en"), (2, "/lib/de"), (3, "/lib/es"), (4, "/lib/fr")], "id int, path string")


ROOTS = "roots(id, path) AS (VALUES (1, '/lib/en'), (2, '/lib/de'), (3, '/lib/es'), (4, '/lib/fr'))"


def members_and_groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored groups: the exact groups of all photos, identified by their smallest photo."""
    derived = G.exact_groups(photos(spark, d))
    heads = derived.groupBy("kind", "key").agg(F.min("photo_id").alias("group_id"), F.max("keeper_photo_id").alias("keeper_photo_id"))
    status = F.when(F.col("group_id") % 7 == 0, "dismissed").when(F.col("group_id") % 5 == 0, "reviewed").otherwise("pending")
    groups = heads.select("group_id", "kind", "key", status.alias("status"), "keeper_photo_id")
    members = derived.join(heads.select("key", "group_id"), "key").select("group_id", "photo_id", "similarity_pct")
    return members, groups


GROUPS = f"""{PHOTOS},
heads AS (SELECT sha256 AS key, min(id) AS group_id, arg_max(id, (width::BIGINT * height, size_bytes, -id)) AS keeper_photo_id FROM photos GROUP BY sha256 HAVING count(*) > 1),
groups AS (SELECT group_id, 'exact' AS kind, key, CASE WHEN group_id % 7 = 0 THEN 'dismissed' WHEN group_id % 5 = 0 THEN 'reviewed' ELSE 'pending' END AS status, keeper_photo_id FROM heads),
members AS (SELECT group_id, id AS photo_id, 100 AS similarity_pct FROM photos JOIN heads ON sha256 = key)"""


def decisions(members: DataFrame) -> DataFrame:
    """A third of the members removed, a third kept, a third open."""
    choice = F.when(F.col("photo_id") % 3 == 0, "remove").when(F.col("photo_id") % 3 == 1, "keep")
    return members.select("group_id", "photo_id", choice.alias("decision")).where("decision is not null")


DECISIONS = "decisions AS (SELECT group_id, photo_id, CASE photo_id % 3 WHEN 0 THEN 'remove' ELSE 'keep' END AS decision FROM members WHERE photo_id % 3 < 2)"


def operations(spark: SparkSession, d: str) -> DataFrame:
    op = F.expr("CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'quarantine' WHEN 'view' THEN 'restore' ELSE 'organize' END")
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("photo_id"), op.alias("op"),
        F.concat(F.lit("/lib/op_"), F.col("event_id").cast("string")).alias("src_path"), F.floor(F.col("value") * 100).cast("long").alias("size_bytes"), F.col("ts").alias("performed_at"),
    )


OPERATIONS = """operations AS (SELECT event_id AS id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS photo_id,
 CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'quarantine' WHEN 'view' THEN 'restore' ELSE 'organize' END AS op,
 '/lib/op_' || event_id AS src_path, CAST(floor(value * 100) AS BIGINT) AS size_bytes, ts AS performed_at FROM events)"""


def scans(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END")
    return read(spark, d, "events").where("event_id % 50 = 0").select(F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("finished_at"))


SCANS = "scans AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, ts AS finished_at FROM events WHERE event_id % 50 = 0)"


def index_and_disk(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one library: some files gone, some moved, some changed, some new."""
    p = photos(spark, d).select("id", "root_id", "path", "size_bytes", "mtime_ns", "status", "sha256")
    index = p.where("id % 10 <> 9")
    moved = F.when(F.col("id") % 10 == 3, F.regexp_replace("path", "^/lib/", "/lib/moved/")).otherwise(F.col("path"))
    size = F.when(F.col("id") % 10 == 5, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    disk = p.where("id % 10 <> 1").select(moved.alias("path"), size.alias("size_bytes"), "mtime_ns", "sha256", F.when(F.col("id") % 37 == 0, "unreadable").alias("error"))
    return index, disk


INDEX = """idx AS (SELECT id, root_id, path, size_bytes, mtime_ns, status, sha256 FROM photos WHERE id % 10 <> 9),
disk AS (SELECT CASE WHEN id % 10 = 3 THEN regexp_replace(path, '^/lib/', '/lib/moved/') ELSE path END AS path,
 size_bytes + CASE WHEN id % 10 = 5 THEN 1 ELSE 0 END AS size_bytes, mtime_ns, sha256, CASE WHEN id % 37 = 0 THEN 'unreadable' END AS error FROM photos WHERE id % 10 <> 1),
classes AS (SELECT coalesce(d.path, i.path) AS path, i.id, CASE WHEN d.path IS NULL THEN 'unseen' WHEN d.error IS NOT NULL THEN 'unreadable' WHEN i.id IS NULL THEN 'added'
  WHEN i.status = 'active' AND d.size_bytes = i.size_bytes AND d.mtime_ns = i.mtime_ns THEN 'unchanged' ELSE 'changed' END AS class, i.status
 FROM disk d FULL JOIN idx i ON d.path = i.path),
vanished AS (SELECT i.*, row_number() OVER (PARTITION BY i.sha256 ORDER BY i.root_id, i.id) AS k FROM idx i JOIN classes c ON c.id = i.id WHERE c.class = 'unseen'),
fresh AS (SELECT d.*, row_number() OVER (PARTITION BY d.sha256 ORDER BY d.path DESC) AS k FROM disk d JOIN classes c ON c.path = d.path WHERE c.class = 'added'),
moves AS (SELECT v.id AS old_id, v.path AS old_path, f.path AS new_path FROM vanished v JOIN fresh f USING (sha256, k))"""


def places(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return read(spark, d, "nation").select(
        F.col("n_name").alias("city"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"), F.left("n_name", F.lit(2)).alias("country"),
        ((n * 7919 % 17000) / F.lit(100.0) - 85).alias("latitude"), ((n * 104729 % 36000) / F.lit(100.0) - 180).alias("longitude"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return read(spark, d, "customer").select(c.alias("id"), ((c * 37 % 18000) / F.lit(100.0) - 90).alias("latitude"), ((c * 7307 % 36000) / F.lit(100.0) - 180).alias("longitude"))


PLACES = """places AS (SELECT n_name AS city, 'R' || n_regionkey AS region, left(n_name, 2) AS country,
 (n_nationkey::BIGINT * 7919 % 17000) / 100.0::DOUBLE - 85 AS latitude, (n_nationkey::BIGINT * 104729 % 36000) / 100.0::DOUBLE - 180 AS longitude FROM nation),
points AS (SELECT c_custkey AS id, (c_custkey * 37 % 18000) / 100.0::DOUBLE - 90 AS latitude, (c_custkey * 7307 % 36000) / 100.0::DOUBLE - 180 AS longitude FROM customer)"""
