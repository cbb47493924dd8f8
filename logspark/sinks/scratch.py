"""Intermediate tables below the cluster's ``spark.checkpoint.dir``.

A frame that several later steps read is written once and read back, so no
step evaluates it anew and a lost executor costs only its running tasks.
What a Python process has written so goes when the process ends.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..config import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = os.path.join(checkpoint_dir(spark), "logspark", name, uuid.uuid4().hex)
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended: nothing can be deleted through it
        pass
