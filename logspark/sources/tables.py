"""Readers for the stored tables and the log frames derived from them.

The test tables hold an ``events`` table; the engine's log frames (``logs``,
``raw_events``, ``access``) are projections of it, so every query's work
grows with the stored data.  A deployment that stores logs directly reads
them with :func:`read_logs` instead.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import LOG_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, listed anew on every call: rows appended since are read."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_logs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored log table (Parquet partitioned by date, or JDBC via options)."""
    if fmt == "parquet":
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    return spark.read.format(fmt).load(path)


@dataclass(frozen=True)
class JdbcSource:
    """Where the original service's Postgres table is."""
    url: str
    table: str = "logs"
    user: str | None = None
    password: str | None = None
    driver: str = "org.postgresql.Driver"
    num_partitions: int = 64
    fetch_size: int = 10_000

    def options(self) -> dict[str, str]:
        out = {"url": self.url, "driver": self.driver, "fetchsize": str(self.fetch_size)}
        if self.user:
            out |= {"user": self.user, "password": self.password or ""}
        return out

    def ranges(self, lower: int, upper: int) -> dict[str, str]:
        """Options that cut ids ``lower`` to ``upper`` into ranges of equal length."""
        return {"partitionColumn": "id", "lowerBound": str(lower), "upperBound": str(upper + 1),
                "numPartitions": str(max(1, min(self.num_partitions, upper - lower + 1)))}


def read_jdbc_logs(spark: SparkSession, source: JdbcSource) -> DataFrame:
    """The stored table, read in id ranges in parallel; the bounds are the
    table's own smallest and largest id, asked for first."""
    ask = f"(SELECT min(id) AS lo, max(id) AS hi FROM {source.table}) AS bounds"
    bounds = spark.read.format("jdbc").options(**source.options()).option("dbtable", ask).load().first()
    lower, upper = (bounds["lo"], bounds["hi"]) if bounds and bounds["lo"] is not None else (0, 0)
    return (spark.read.format("jdbc").options(**source.options(), **source.ranges(lower, upper))
            .option("dbtable", source.table).load().withColumnRenamed("timestamp", "log_ts"))


# fixed values: log sources assigned by user_id % 8 in the derived log view
SOURCES_BY_MOD8 = ("database_service", "auth_service", "api_service", "system_monitor",
                   "backup_service", "security_service", "cache_service", "unknown")
# fixed values: request paths assigned by event_id % 5 in the derived access view
ACCESS_PATHS = ("/health", "/logs", "/ingest", "/a%20b", "/healthz")


def _arr(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


LOGS_EXPRS = (
    "event_id AS id",
    "ts AS log_ts",
    f"element_at({_arr(SOURCES_BY_MOD8)}, CAST(user_id % 8 + 1 AS INT)) AS source",
    """CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'fatal'
       WHEN event_type = 'error' THEN 'error'
       WHEN user_id % 8 = 0 AND event_type IN ('click', 'view') THEN 'error'
       WHEN user_id % 8 = 2 AND event_type = 'click' THEN 'error'
       WHEN event_type = 'signup' THEN 'warn' WHEN event_type = 'view' THEN 'debug'
       ELSE 'info' END AS level""",
    """CASE event_id % 7
       WHEN 0 THEN concat('Database connection failed after ', CAST(event_id % 5 AS STRING), ' retries')
       WHEN 1 THEN concat('Request timeout while processing /api/users (took ', CAST(floor(value * 20) AS STRING), 'ms)')
       WHEN 2 THEN concat('Failed login attempt for user admin from IP 192.168.1.', CAST(user_id % 255 AS STRING))
       WHEN 3 THEN concat('User authentication successful for user_', CAST(user_id AS STRING))
       WHEN 4 THEN CASE WHEN event_id % 3 = 0
                        THEN concat('SQL injection attempt detected in parameter ', CAST(user_id AS STRING))
                        ELSE concat('Permission denied for object deadbeef', CAST(1000 + event_id % 9 AS STRING)) END
       WHEN 5 THEN concat('Cache cleared successfully, duration: ', CAST(floor(value) AS STRING), 's')
       ELSE concat('Disk space usage at ', CAST(event_id % 100 AS STRING), '% on server-01') END AS message""",
)

RAW_EVENTS_EXPRS = (
    "event_id AS id",
    """CASE event_id % 9
       WHEN 0 THEN concat('{"log":"legacy entry ', CAST(event_id AS STRING), '"}')
       WHEN 1 THEN '{"invalid":"format"}'
       WHEN 2 THEN 'invalid json'
       WHEN 3 THEN '{"message":"","level":"info"}'
       WHEN 4 THEN '{"message":"no level"}'
       WHEN 5 THEN '{"message":"mixed case","level":"Warn"}'
       WHEN 6 THEN '{"message":"no source","level":"ERROR","timestamp":"2024-01-15T10:30:00Z"}'
       WHEN 7 THEN '{"message":"bad time","level":"warn","timestamp":"2024-01-15 10:30:00"}'
       ELSE concat('{"message":"ok ', CAST(event_id AS STRING),
                   '","level":"debug","source":"db-service","timestamp":"2024-01-15T10:31:00Z"}') END AS payload""",
)

ACCESS_EXPRS = (
    "event_id AS id",
    "ts AS log_ts",
    "CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS http_method",
    f"element_at({_arr(ACCESS_PATHS)}, CAST(event_id % 5 + 1 AS INT)) AS http_path",
    "CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 400 ELSE 202 END AS http_status_code",
    "floor(value * 40) AS duration_ms",
    "concat('10.0.0.', CAST(user_id % 3 AS STRING)) AS http_remote_addr",
    "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'curl/8' END AS http_user_agent",
)


def logs_from_events(events: DataFrame) -> DataFrame:
    """``logs(id, log_ts, source, level, message)`` derived from ``events``."""
    return events.selectExpr(*LOGS_EXPRS)


def raw_events_from_events(events: DataFrame) -> DataFrame:
    """``raw_events(id, payload)``: ingest payloads covering every accept/reject route."""
    return events.selectExpr(*RAW_EVENTS_EXPRS)


def access_from_events(events: DataFrame) -> DataFrame:
    """``access(id, log_ts, http_method, http_path, http_status_code, duration_ms,
    http_remote_addr, http_user_agent)`` derived from ``events``."""
    return events.selectExpr(*ACCESS_EXPRS)


def load_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from_events(read_table(spark, sf_dir, "events"))


def load_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events_from_events(read_table(spark, sf_dir, "events"))


def load_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_from_events(read_table(spark, sf_dir, "events"))
