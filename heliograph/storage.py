"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
again.  The folder is the one the cluster names in ``spark.checkpoint.dir``;
only where that is unset (tests, a laptop) is a local one made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; reads ``spark.checkpoint.dir`` and sets one only where it is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="heliograph-")
        spark.sparkContext.setCheckpointDir(f"file://{_own[app]}")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A run's own folder below the shared one, holding tables by name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/heliograph/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back: its lineage ends here."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        _delete(self.spark, f"{self.base}/{name}")


#: How much larger a written table may be in memory than in its files.
EXPANDS = 8


def written_bytes(table: DataFrame) -> int:
    """The size of the folders whose files ``table`` is read from."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = [jvm.org.apache.hadoop.fs.Path(x) for x in {f.rsplit("/", 1)[0] for f in table.inputFiles()}]
    return sum(x.getFileSystem(conf).getContentSummary(x).getLength() for x in folders)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``small``, read from a written table, only if its files show that it takes about ``max_bytes`` at most; else Spark shuffles both sides."""
    if written_bytes(small) * EXPANDS <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, on, how)
