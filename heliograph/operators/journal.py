"""Carrying out a plan in batches that can be resumed: a folder for each batch, written whole or not at all.

A batch's outcome follows from the plan and the state it was planned for, and moving a file
is done again without harm, so a batch that a stop has cut off is simply carried out once
more; one whose folder is complete never is.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.columns import basename, dirname
from heliograph.operators.ranks import numbered
from heliograph.storage import Scratch

OUTCOME = "id long, src string, dest string, size_bytes long, error string"


def moved_file(src: str, dest: str) -> None:
    """Move a file unless that is done; never over another one."""
    if os.path.lexists(dest):
        if os.path.lexists(src):
            raise FileExistsError(f"{dest} exists")
        return
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    os.rename(src, dest)


class Journal:
    """The batches of one plan below ``base``: moves (id, src, dest, size_bytes), ``size`` to a batch in the order of their sources."""

    def __init__(self, spark: SparkSession, base: str, size: int = 200):
        self.spark, self.base, self.size = spark, base.rstrip("/"), size

    def plan(self, moves: DataFrame) -> None:
        """Write the plan once; the batches that a resumed run finds are those of the first."""
        own = Scratch(self.spark, "plan").table(moves.select("id", "src", "dest", "size_bytes"), "moves")
        turns = numbered(own, [], ["src", "id"], "turn").withColumn("batch", F.floor(F.col("turn") / self.size).cast("long"))
        turns.write.mode("errorifexists").parquet(f"{self.base}/plan")

    def _files(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/batches")
        return path, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def done(self) -> list[int]:
        """The first batch of each complete folder's range, in order."""
        path, fs, new = self._files()
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName().removeprefix("from=")) for p in found if fs.exists(new(p, "_SUCCESS")))

    def run(self, photos: DataFrame, perform: Callable[[str, str], None] | None = None, together: int = 50, stop_after: int | None = None) -> int:
        """Carry out what is left, ``together`` batches a job; returns how many jobs it took.

        A move whose photo is no longer active at its source when the run starts fails, and so
        does one that ``perform(src, dest)`` refuses, in its task; the others go on.  Plan and
        photos are read once a run, and every job reads its own folder of what that gives.
        """
        plan = self.spark.read.parquet(f"{self.base}/plan")
        last = plan.agg(F.max("batch")).first()[0]
        complete = set(self.done())
        todo = [first for first in range(0, -1 if last is None else last + 1, together) if first not in complete][:stop_after]
        if not todo:
            return 0
        ready = f"{Scratch(self.spark, 'ready').base}/moves"
        first = F.col("batch") - F.pmod("batch", F.lit(together))
        own = plan.withColumn("first", first).where(F.col("first").between(todo[0], todo[-1]))
        own = own.join(self.spark.createDataFrame([(x,) for x in todo], "first long"), "first", "left_semi")
        now = photos.where("status = 'active'").select("id", F.col("path").alias("src"), F.lit(True).alias("there"))
        own = own.join(now, ["id", "src"], "left").withColumn("error", F.when(F.col("there").isNull(), "photo changed since planning"))
        # a folder a job, of about 10,000 moves a file
        own = own.repartition("first", F.floor(F.col("batch") * self.size / 10_000)).select("id", "src", "dest", "size_bytes", "error", "first")
        own.write.partitionBy("first").parquet(ready)
        for k in todo:
            own = self.spark.read.schema(OUTCOME).parquet(f"{ready}/first={k}")
            if perform:
                own = own.mapInArrow(_performed(perform), OUTCOME)
            own.write.mode("overwrite").parquet(f"{self.base}/batches/from={k}")
        return len(todo)

    def outcome(self) -> DataFrame:
        """(id, src, dest, size_bytes, error) of all complete batches."""
        paths = [f"{self.base}/batches/from={b}" for b in self.done()]
        return self.spark.read.schema(OUTCOME).parquet(*paths) if paths else self.spark.createDataFrame([], OUTCOME)

    def applied(self, photos: DataFrame) -> DataFrame:
        """``photos`` after the complete batches: what was moved has its new path."""
        good = self.outcome().where("error is null").select("id", "dest")
        path = F.coalesce("dest", "path")
        new = {"path": path, "filename": basename(path), "directory": dirname(path)}
        return photos.join(good, "id", "left").withColumns({k: v for k, v in new.items() if k in photos.columns}).select(photos.columns)


def _performed(perform: Callable[[str, str], None]):
    def one(src: str, dest: str, error: str | None) -> str | None:
        if error is None:
            try:
                perform(src, dest)
            except OSError as e:
                return str(e)
        return error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [one(*r) for r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(errors, pa.string())], batch.schema.names)

    return run
