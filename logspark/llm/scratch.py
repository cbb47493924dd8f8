"""Intermediate tables in the folder that the cluster shares.

An operator that reads an intermediate result more than once writes it as
Parquet below ``spark.checkpoint.dir`` and reads it back: this cuts the
lineage, and a lost executor costs no more than its running tasks.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  A local session without one (tests) gets a
    temporary folder; a cluster must name it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="logspark-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables of one operator call.  ``write`` materialises a frame and
    returns it as read back; ``drop`` deletes tables no longer needed; what
    is left goes when the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def free_shuffles(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs: it
        acts on frames that the driver's collector has found unreachable."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: nothing can be deleted through it
            pass
