"""Structured Streaming jobs.

* :func:`ingest_stream` - continuous ingest: raw payloads are validated per
  micro-batch and written to an accepted and a quarantine table.  Each batch
  overwrites its own ``batch_id=`` partition, so a retried batch replaces
  its earlier attempt instead of duplicating it (exactly-once output on top
  of the checkpointed source offsets).
* :func:`window_counts_stream` - tumbling event-time windows with a
  watermark, emitted in append mode once the watermark passes the window
  end (state holds only the open windows).
* :func:`rate_limit_stream` - per-client tumbling windows with the rate classes.
* :func:`monitor_stream` - per micro-batch summary and alerts (the
  30-second monitoring loop of the original CLI, as a trigger interval).

All jobs take the checkpoint location from the caller; the helpers under
``logspark.plans`` put it below the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from ..operators import errors as E
from ..plans import report as RP
from ..sources import ingest as IG


def read_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def read_table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stored Parquet table as a stream: a folder of part files, with files
    that come later, or one file (a stream reads folders, so its own folder
    is read with the other files left out)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return read_stream(spark, path, schema, max_files=max_files)
    folder, _, name = path.rpartition("/")
    return read_stream(spark, folder, schema, glob=name, max_files=max_files)


def _trigger(writer, available_now: bool, interval: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval or "30 seconds")


def ingest_stream(raw: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True,
                  interval: str | None = None, ingest_ts=None):
    """Validate a stream of ``(id, payload)`` rows into ``out_dir/accepted``
    and ``out_dir/rejects``."""
    routed = IG.route_payloads(raw, ingest_ts=ingest_ts)

    def sink(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        IG.accepted(batch).write.mode("overwrite").parquet(f"{out_dir}/accepted/batch_id={batch_id}")
        IG.rejects(batch).write.mode("overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
        batch.unpersist()

    w = routed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def _event_time(df: DataFrame, col: str = "log_ts") -> DataFrame:
    # watermarks need a session-zone timestamp; the session zone is UTC
    return df.withColumn(col, F.col(col).cast("timestamp"))


def window_counts_stream(logs: DataFrame, out_dir: str, checkpoint: str, window: str = "10 minutes",
                         delay: str = "10 minutes", available_now: bool = True, interval: str | None = None):
    """Per tumbling window: volume and error+fatal count, appended when final."""
    s = _event_time(logs).withWatermark("log_ts", delay)
    lv = L.norm_level(F.col("level"))
    agg = (s.groupBy(F.window("log_ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("volume"), F.count(F.when(L.is_narrow_error(lv), 1)).alias("error_count"))
           .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                   F.col("w.end").cast("timestamp_ntz").alias("window_end"), "volume", "error_count"))
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, interval).start()


def rate_limit_stream(access: DataFrame, out_dir: str, checkpoint: str, window: str = "1 minute",
                      delay: str = "1 minute", cfg: EngineConfig = DEFAULT, available_now: bool = True,
                      interval: str | None = None):
    """Per client and tumbling window: request count and rate classes."""
    s = _event_time(access).withWatermark("log_ts", delay)
    agg = (s.groupBy("http_remote_addr", F.window("log_ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("requests")))
    n = F.col("requests")
    out = agg.select(
        "http_remote_addr", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests",
        F.least(n, F.lit(cfg.rate_notice)).alias("ok"),
        F.least(F.greatest(n - cfg.rate_notice, F.lit(0)), F.lit(cfg.rate_limit - cfg.rate_notice)).alias("high_rate"),
        F.greatest(n - cfg.rate_limit, F.lit(0)).alias("rejected"))
    w = (out.writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, interval).start()


def monitor_stream(logs: DataFrame, out_dir: str, checkpoint: str, cfg: EngineConfig = DEFAULT,
                   available_now: bool = True, interval: str | None = "30 seconds"):
    """Per micro-batch: status line (volume, error rate, health, anomalies)
    to ``out_dir/status`` and the batch's alerts to ``out_dir/alerts``."""
    from ..operators import anomalies as AN

    def sink(batch: DataFrame, batch_id: int):
        b = batch.persist()
        if b.isEmpty():
            b.unpersist()
            return
        ef = E.error_frequency(b)
        an = AN.rule_anomalies(b, cfg).agg(F.count(F.lit(1)).alias("anomalies"))
        status = ef.crossJoin(an).select(
            "total_logs", "total_errors", "error_rate",
            L.health_status(F.col("error_rate")).alias("health_status"), "anomalies")
        status.write.mode("overwrite").parquet(f"{out_dir}/status/batch_id={batch_id}")
        RP.alerts(b, cfg).write.mode("overwrite").parquet(
            f"{out_dir}/alerts/batch_id={batch_id}")
        b.unpersist()

    w = logs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def dedup_stream(logs: DataFrame, delay: str = "10 minutes", key: str = "id") -> DataFrame:
    """Drop re-delivered rows (same ``key``) that arrive within the watermark
    delay; state is bounded by the watermark."""
    return _event_time(logs).withWatermark("log_ts", delay).dropDuplicatesWithinWatermark([key])
