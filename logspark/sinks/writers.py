"""Sinks: the log table, the quarantine table, alerts and report export.

Tables are appended to.  A caller that may run twice names its unit of work:
``write_logs(..., unit=...)`` then replaces what that unit has written, and
other sinks take ``mode="overwrite"`` with a path of their own (the streaming
jobs write one ``batch_id=`` folder each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 5_000_000


def write_logs(df: DataFrame, path: str, mode: str = "append", unit: str | None = None, files: int | None = None,
               rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write logs to a Parquet table partitioned by day (``created_at`` is
    stamped here, like the store's column default).

    Rows are range-partitioned by day, time and id, so that a task's files
    hold a stretch of time (readers skip files by their time bounds) and a day
    or hour that holds most rows is written by many tasks; ``files`` is the
    number of stretches (default: the session's shuffle partitions), and no
    file has more than ``rows_per_file`` rows.  Rows without a time come first.

    With ``unit`` the table is also partitioned by it and the write replaces
    that unit's partitions of the days it holds: a retry of the same rows
    leaves the table as it was after the first attempt.  A table is written
    either with units or without.
    """
    out = df.withColumn("created_at", F.coalesce(
        F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp_ntz"),
        F.current_timestamp().cast("timestamp_ntz")))
    out = out.withColumn("date", F.to_date("log_ts"))
    order = [F.col("date").asc_nulls_first(), F.col("log_ts").asc_nulls_first(), F.col("id")]
    out = out.repartitionByRange(files, *order) if files else out.repartitionByRange(*order)
    out = out.sortWithinPartitions(*order)
    if unit is None:
        out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(path)
    else:
        (out.withColumn("unit", F.lit(unit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("maxRecordsPerFile", rows_per_file).partitionBy("date", "unit").parquet(path))


def read_written_logs(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_logs`` made, without the units' names."""
    return spark.read.parquet(path).drop("unit")


def write_rejects(rejects: DataFrame, path: str, mode: str = "append") -> None:
    rejects.write.mode(mode).parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def export_report_json(report: DataFrame, path: str) -> None:
    """The one-row report as a JSON document (non-JSON values as text)."""
    report.coalesce(1).write.mode("overwrite").json(path)
