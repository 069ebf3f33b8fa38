"""Queries on pictures: image files assembled byte by byte from ``documents`` and read back, and pictures drawn from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.pictures import LOW, SIDE, with_perceptual_hash
from heliograph.operators import groups as G
from heliograph.plans import proxies as P
from heliograph.plans.registry import query
from heliograph.sources.headers import described
from heliograph.storage import Scratch

def _number(x: Column | int, size: int = 4, big: bool = True) -> Column:
    """A whole number as hex digits of ``size`` bytes in either byte order."""
    if isinstance(x, int):
        return F.lit(x.to_bytes(size, "big" if big else "little").hex().upper())
    digits = F.lpad(F.hex(x), 2 * size, "0")
    return digits if big else F.concat(*(F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))))


def _ascii(text: Column | str, size: int = 0) -> Column:
    """A text as hex digits, padded with NULs to ``size`` bytes."""
    if isinstance(text, str):
        return F.lit(text.encode().ljust(size, b"\0").hex().upper())
    return F.rpad(F.hex(text.cast("binary")), 2 * size, "0")


def _bytes_of(digits: Column) -> Column:
    return (F.length(digits) / 2).cast("long")


def _tiff_block(big: bool) -> Column:
    """A TIFF block of 8 + 102 + 40 + 18 + 20 + 54 + 48 bytes, its directories one after the other, as hex digits."""
    i = F.col("doc_id")
    moment = F.timestamp_add("HOUR", F.pmod(i, F.lit(200_000)).cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    stamp = lambda t: _ascii(F.date_format(t, "yyyy:MM:dd HH:mm:ss"), 20)
    junk = _ascii("0000:00:00 00:00:00", 20)
    n = lambda x, size=4: _number(x, size, big)
    entry = lambda tag, kind, count, value: [n(tag, 2), n(kind, 2), n(count), value]
    letter = lambda c, a, b: F.when(c, _ascii(a, 4)).otherwise(_ascii(b, 4))
    over = F.when(i % 13 == 0, n(0)).otherwise(n(100))
    angle = lambda whole: [n(i % whole), n(1), n(i % 60), n(1), n(i % 6000), over]
    main = entry(256, 4, 1, n(i % 4000 + 1)) + entry(257, 4, 1, n(i % 3000 + 1)) + entry(271, 2, 8, n(110)) + entry(272, 2, 12, n(118))
    main += [*entry(274, 3, 1, n(i % 8 + 1, 2)), F.lit("0000"), *entry(306, 2, 20, n(130)), *entry(34665, 4, 1, n(150)), *entry(34853, 4, 1, n(188))]
    gps = entry(1, 2, 2, letter(i % 2 == 1, "S", "N")) + entry(2, 5, 3, n(242)) + entry(3, 2, 2, letter(i % 3 == 0, "W", "E")) + entry(4, 5, 3, n(266))
    taken, original = F.when(i % 12 == 0, junk).otherwise(stamp(moment)), F.when(i % 6 == 0, junk).otherwise(stamp(moment + F.expr("INTERVAL 1 DAY")))
    return F.concat(
        F.lit("4D4D002A" if big else "49492A00"), n(8), n(8, 2), *main, n(0), _ascii(F.col("lang"), 8), _ascii(F.concat(F.lit(" "), "source"), 12), taken,
        n(1, 2), *entry(36867, 2, 20, n(168)), n(0), original, n(4, 2), *gps, n(0), *angle(100), *angle(180),
    )


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a JPEG, PNG, WebP, TIFF, GIF or HEIF file of every document; some cut short, some plain text, some nothing."""
    i = F.col("doc_id")
    width, height, tiff = i % 4000 + 1, i % 3000 + 1, F.col("tiff")
    docs = P.read(spark, d, "documents").select(i, "text", F.when(i % 6 < 4, F.when(i % 3 == 0, _tiff_block(True)).otherwise(_tiff_block(False))).alias("tiff"))
    n = _number
    chunk = lambda name, body: [n(_bytes_of(body)), _ascii(name), body, F.lit("00000000")]
    box = lambda name, size, body: [n(size + 8), _ascii(name), *body]
    jpeg = [F.lit("FFD8FFE1"), n(_bytes_of(tiff) + 8, 2), _ascii("Exif"), F.lit("0000"), tiff, F.lit("FFC0000B08"), n(height, 2), n(width, 2), F.lit("01011100FFDA0002" + "AB" * 9 + "FFD9")]
    png = [F.lit("89504E470D0A1A0A"), n(13), _ascii("IHDR"), n(width), n(height), F.lit("080000000000000000"), *chunk("eXIf", tiff), n(0), _ascii("IEND"), n(0)]
    webp = [_ascii("RIFF"), n(_bytes_of(tiff) + 30, 4, False), _ascii("WEBP"), _ascii("VP8X"), n(10, 4, False), F.lit("08000000"), n(width - 1, 3, False), n(height - 1, 3, False), _ascii("EXIF"), n(_bytes_of(tiff), 4, False), tiff]
    gif = [_ascii("GIF89a"), n(width, 2, False), n(height, 2, False), F.lit("000000" + "2C" * 16 + "3B")]
    heif = [*box("ftyp", 8, [_ascii("heic"), n(0)]), *box("meta", 40, [n(0), *box("iprp", 28, box("ipco", 20, box("ispe", 12, [n(0), n(width), n(height)])))])]
    forms = [jpeg, png, webp, [tiff], gif, heif]
    digits = F.lit(None)
    for k, parts in enumerate(forms):
        digits = F.when(i % 6 == k, F.concat(*parts)).otherwise(digits)
    files = docs.select(i, "text", F.unhex(digits).alias("whole"))
    content = F.when(i % 19 == 0, None).when(i % 17 == 0, F.col("text").cast("binary")).when(i % 11 == 0, F.substring("whole", 1, 20)).otherwise(F.col("whole"))
    return files.select(i.cast("string").alias("path"), content.alias("content"))


@query(
    "s03_headers",
    """
WITH files AS (
  SELECT doc_id AS i, lang, source, doc_id % 19 = 0 OR doc_id % 17 = 0 OR doc_id % 11 = 0 AS failed, doc_id % 6 AS kind, doc_id % 6 < 4 AS tagged, doc_id % 6 < 4 AND doc_id % 8 >= 4 AS turned,
    TIMESTAMP '2020-01-01 00:00:00' + to_hours(doc_id % 200000) AS moment,
    (doc_id % 100 + doc_id % 60 / 60.0::DOUBLE + doc_id % 6000 / 100.0::DOUBLE / 3600) * CASE WHEN doc_id % 2 = 1 THEN -1 ELSE 1 END AS lat,
    (doc_id % 180 + doc_id % 60 / 60.0::DOUBLE + doc_id % 6000 / 100.0::DOUBLE / 3600) * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END AS lon
  FROM documents
), seen AS (SELECT *, tagged AND i % 13 <> 0 AND abs(lat) <= 90 AND abs(lon) <= 180 AS placed FROM files)
SELECT i::VARCHAR AS path, failed, CASE WHEN NOT failed THEN ['jpeg', 'png', 'webp', 'tiff', 'gif', 'heic'][kind + 1] END AS format,
  CASE WHEN failed THEN NULL WHEN turned THEN i % 3000 + 1 ELSE i % 4000 + 1 END::INT AS width, CASE WHEN failed THEN NULL WHEN turned THEN i % 4000 + 1 ELSE i % 3000 + 1 END::INT AS height,
  CASE WHEN NOT failed AND tagged AND i % 12 <> 0 THEN strftime(moment + to_days(CASE WHEN i % 6 = 0 THEN 0 ELSE 1 END), '%Y-%m-%d %H:%M:%S') END AS captured_at,
  CASE WHEN NOT failed AND tagged THEN lang END AS camera_make, CASE WHEN NOT failed AND tagged THEN source END AS camera_model,
  CASE WHEN NOT failed AND placed THEN lat END AS latitude, CASE WHEN NOT failed AND placed THEN lon END AS longitude
FROM seen
""",
)
def _(spark, d):
    out = described(image_files(spark, d)).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss"))
    return out.select("path", F.col("error").isNotNull().alias("failed"), "format", "width", "height", "captured_at", "camera_make", "camera_model", "latitude", "longitude")


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(id, pixels): a grey picture of every text, one hexadecimal digit a pixel, line by line from a digest of the text and the line."""
    docs = P.read(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.md5(F.lower("text").cast("binary")).alias("m"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.md5(F.concat("m", y.cast("string")).cast("binary")))
    digit = lambda line, x: F.conv(F.substr(line, x, F.lit(1)), 16, 10).cast("int")
    return docs.select("id", F.flatten(F.transform(lines, lambda line: F.transform(F.sequence(F.lit(1), F.lit(SIDE)), lambda x: digit(line, x)))).alias("pixels"))


_SPECTRUM = f"""
lines AS (SELECT doc_id AS id, y, md5(md5(lower(text)) || y) AS line FROM documents, range({SIDE}) t(y) WHERE text IS NOT NULL),
pixels AS (SELECT id, y, x, instr('0123456789abcdef', line[x + 1]) - 1 AS p FROM lines, range({SIDE}) t(x)),
wave AS (SELECT k, z, 2 * cos(pi() * k * (2 * z + 1) / {2 * SIDE}) AS c FROM range({LOW}) a(k), range({SIDE}) b(z)),
across AS (SELECT id, y, k AS v, sum(p * c) AS s FROM pixels JOIN wave ON z = x GROUP BY id, y, k),
low AS (SELECT id, k AS u, v, round(sum(s * c), 6) AS f FROM across JOIN wave ON z = y GROUP BY id, k, v),
prints AS (SELECT id, sum(CASE WHEN f > m AND u + v > 0 THEN (1::HUGEINT << (63 - 8 * u - v)::INT) ELSE 0 END) - max(CASE WHEN f > m AND u + v = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END) AS phash
 FROM (SELECT *, median(f) OVER (PARTITION BY id) AS m FROM low) GROUP BY id)"""


@query("m09_perceptual_hash", f"WITH {_SPECTRUM} SELECT id, phash::BIGINT::VARCHAR AS phash FROM prints")
def _(spark, d):
    return with_perceptual_hash(pictures(spark, d)).withColumn("phash", F.col("phash").cast("string"))


@query(
    "m09_picture_groups",
    f"WITH {P.PHOTOS}, {_SPECTRUM}, twins AS (SELECT phash FROM prints JOIN photos USING (id) GROUP BY phash HAVING count(DISTINCT sha256) > 1) SELECT id AS photo_id FROM prints JOIN twins USING (phash)",
)
def _(spark, d):
    """Photos whose pictures are alike though their bytes differ: texts that differ in case only have one picture."""
    own = P.photos(spark, d).join(with_perceptual_hash(pictures(spark, d)), "id")
    return G.similar_groups(Scratch(spark, "m09").table(own, "photos"), 1).select("photo_id")
