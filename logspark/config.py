"""Engine configuration and session helpers.

All thresholds of the analyses live in one frozen dataclass so that a job can
override them without touching code.  Defaults are the values the original
service ships with.
"""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: thresholds shipped by the original analytics service
    alert_threshold: float = 5.0              # error rate (percent) that raises an alert
    anomaly_detection_enabled: bool = True
    auto_alert_enabled: bool = True
    performance_threshold_ms: float = 5000.0  # slow operation
    slow_request_ms: float = 1000.0           # "slow request" in trend indicators
    threshold_multiplier: float = 2.0         # rule-based frequent error patterns
    window_minutes: int = 10                  # temporal anomaly windows
    high_error_rate_pct: float = 20.0         # per-source error-rate anomaly
    min_source_logs: int = 5                  # ... only above this volume
    ml_confidence_threshold: float = 0.7      # CLI --threshold
    clustering_threshold: float = 0.7         # time-clustering anomaly
    baseline_days: int = 7
    recent_limit: int = 1000
    access_slow_ms: int = 5000                # slow HTTP request (strictly greater)
    db_slow_ms: float = 100.0                 # slow database operation
    rate_limit: int = 100                     # requests per client per window -> rejected
    rate_notice: int = 50                     # requests per client per window -> high
    rate_window: str = "1 minute"
    # response-time unit handling: 'intended' (only seconds are scaled) or
    # 'reference' (every matched pattern is scaled by 1000, as the service does)
    unit_mode: str = "intended"


DEFAULT = EngineConfig()


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "logspark") -> SparkSession:
    """Session with the settings the engine relies on (UTC, AQE)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    # driver-side settings only take effect when this call starts the JVM
    b = (b.config("spark.driver.memory", os.environ.get("LOGSPARK_DRIVER_MEMORY", "8g"))
          .config("spark.sql.ui.retainedExecutions", "50")
          .config("spark.ui.retainedJobs", "100")
          .config("spark.ui.retainedStages", "200")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    A session on several machines must name it.  A local session, whose only
    machine is this one, may leave it unset; its scratch folder is then made
    below the system's temporary folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="logspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)
    return d
