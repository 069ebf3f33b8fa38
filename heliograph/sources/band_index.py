"""A stored index of perceptual hashes by byte bands: probes read a few partitions, changes rewrite those they touch.

A hash has a row for each of its eight bytes, in the partition of the byte's place and upper
bits, sorted by value.  Two hashes within seven bits share a byte, so a probe finds all
hashes near it in eight of the 8 * PARTS partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.columns import band, hamming
from heliograph.storage import Scratch

PARTS = 16
SCHEMA = "id long, phash long, value int, place int, part int"


def _bands(hashes: DataFrame, phash: str = "phash") -> DataFrame:
    """(id, phash, value, place, part): a row for each byte of each hash."""
    each = F.explode(F.array(*(F.struct(band(phash, b).cast("int").alias("value"), F.lit(b).alias("place")) for b in range(8))))
    rows = hashes.where(F.col(phash).isNotNull()).select("id", F.col(phash).alias("phash"), each.alias("k")).select("id", "phash", "k.*")
    return rows.withColumn("part", F.floor(F.col("value") / (256 // PARTS)).cast("int"))


class BandIndex:
    """The index below one folder, partitioned by (place, part)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _write(self, rows: DataFrame) -> None:
        rows = rows.repartition("place", "part").sortWithinPartitions("place", "part", "value")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place", "part").parquet(self.base)

    def build(self, photos: DataFrame) -> None:
        """Index photos (id, phash); those without a hash are left out."""
        self._write(_bands(photos.select("id", "phash")))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.base)

    def merge(self, changes: DataFrame) -> None:
        """Apply changes (id, old_phash, new_phash): a null old hash is a new photo, a null new one a photo that is gone.

        Only the partitions of the changed hashes are read and written again; a merge that
        was cut off is repeated without harm.
        """
        scratch = Scratch(self.spark, "band_index")
        old = _bands(changes.select("id", F.col("old_phash").alias("phash")))
        new = _bands(changes.select("id", F.col("new_phash").alias("phash")))
        touched = scratch.table(old.unionByName(new).select("place", "part").distinct(), "touched")
        names = [(r.place, r.part) for r in touched.collect()]  # 8 * PARTS at most
        if not names:
            return
        inside = F.struct("place", "part").isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in names)) if len(names) < 8 * PARTS else F.lit(True)
        own = self.read().where(inside).join(changes.select("id"), "id", "left_anti")
        merged = scratch.table(own.unionByName(new), "merged")
        gone = touched.join(merged.select("place", "part").distinct(), ["place", "part"], "left_anti").collect()
        self._write(merged)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for r in gone:  # nothing is left there, so nothing was written over it
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/place={r.place}/part={r.part}")
            path.getFileSystem(conf).delete(path, True)

    def near(self, phash: int, threshold: int = 6) -> DataFrame:
        """(id, phash, distance) of the indexed hashes within ``threshold`` bits (7 at most) of one."""
        values = [(phash >> (8 * b)) & 255 for b in range(8)]
        hit = F.lit(False)
        for b, v in enumerate(values):
            hit |= (F.col("place") == b) & (F.col("part") == v // (256 // PARTS)) & (F.col("value") == v)
        found = self.read().where(hit).withColumn("distance", hamming("phash", F.lit(phash).cast("long")).cast("int"))
        return found.where(F.col("distance") <= threshold).select("id", "phash", "distance").distinct()


def similar_indexed(index: BandIndex, photos: DataFrame, photo_id: int, phash: int, threshold: int = 6, limit: int = 12) -> DataFrame:
    """The nearest active photos of a probe by distance, as ``library.similar_to`` finds them, from the index; the few found are joined to their rows."""
    near = index.near(phash, threshold).where(F.col("id") != photo_id).select("id", "distance")
    return photos.where("status = 'active'").join(near, "id").orderBy("distance", "id").limit(min(limit, 50))
