"""Schemas of the engine's frames and the fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: log levels, in ascending order of importance
LEVELS = ("debug", "info", "warn", "error", "fatal")
# fixed values: accepted spellings at ingest (exactly these ten)
VALID_INGEST_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL",
                       "debug", "info", "warn", "error", "fatal")
BROAD_ERROR_LEVELS = ("error", "fatal", "warn")
NARROW_ERROR_LEVELS = ("error", "fatal")

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("log_ts", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

REJECT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("reason", T.StringType()),
])

EXCEPTION_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("traceback", T.ArrayType(T.StringType())),
])

APP_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("function", T.StringType()),
    T.StructField("duration", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("exception", EXCEPTION_TYPE),
])

ACCESS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("log_ts", T.TimestampType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("http_path", T.StringType()),
    T.StructField("http_status_code", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("http_remote_addr", T.StringType()),
    T.StructField("http_user_agent", T.StringType()),
])

ANOMALY_SCHEMA = T.StructType([
    T.StructField("detector", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("count", T.LongType()),
    T.StructField("total_logs", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("expected", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("alert_ts", T.TimestampType()),
    T.StructField("rule", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
])
