"""Tables that cut lineage, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (local runs, tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerlight-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables under one folder; whatever is left of it is deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self._n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.top}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df once, in folders by a column where one is named, and go on from the files."""
        to = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out.scratch_path = to
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no later plan reads; without arguments all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for at in [f.scratch_path for f in frames] or [self.top]:
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone at exit; the folder is scratch space
            if frames:
                raise


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
