"""Tables in the folder that driver and executors share, to cut the lineage of long jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none (tests, local runs).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sessionlake.shared.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sessionlake-")
        spark.conf.set("sessionlake.shared.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    ``write`` stores a DataFrame as Parquet and returns the table that reads it back.
    What a returned (lazy) result still reads stays until the session ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        atexit.register(self._gone)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _gone(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended; its owner clears the folder
            pass
