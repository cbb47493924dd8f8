"""Queries over service-log files: records are written as log files and read
back by the file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks.scratch import scratch_path
from ..sources import applog as AP
from ..sources.tables import load_access
from . import sqlbits as S
from .catalog import R, register

_RECORDS = """rec AS (
 SELECT id, log_ts, 'INFO' AS level, 'Performance: ' || http_method || ' ' || http_path AS message,
  http_method || ' ' || http_path AS operation, NULL AS table_name, duration_ms AS ms,
  CASE WHEN http_status_code >= 400 THEN 'error' ELSE 'success' END AS status, NULL AS event FROM access
 UNION ALL SELECT id, log_ts, CASE WHEN duration_ms % 200 > 100 THEN 'WARN' ELSE 'DEBUG' END,
  CASE WHEN duration_ms % 200 > 100 THEN 'Slow database operation detected' ELSE 'Database operation: INSERT' END,
  'INSERT', 'logs', duration_ms % 200, NULL, NULL FROM access WHERE id % 2 = 0
 UNION ALL SELECT id, log_ts, 'INFO', 'Business event: ' || CASE WHEN id % 10 = 0 THEN 'alert_raised' ELSE 'log_ingested' END,
  NULL, NULL, NULL, NULL, CASE WHEN id % 10 = 0 THEN 'alert_raised' ELSE 'log_ingested' END FROM access WHERE id % 5 = 0)"""
_ROW = """SELECT strftime(log_ts, '{stamp}') AS timestamp, level, message, 'log-ingestion' AS service, 'worker' AS component,
 'trace-' || CAST(id AS VARCHAR) AS trace_id, 'req-' || CAST(id AS VARCHAR) AS request_id,
 CASE WHEN id % 3 = 0 THEN 'user-' || CAST(id % 7 AS VARCHAR) END AS user_id,
 operation, event AS business_event, CAST(ms AS BIGINT) AS duration_ms{more} FROM rec"""
_COLUMNS = ("timestamp", "level", "message", "service", "component", "trace_id", "request_id", "user_id")


def _sql(text: str) -> str:
    return S.with_views(text, logs=False, access=True, extra=_RECORDS)


def _files(spark, d, render) -> str:
    """Log files of the derived records in the shared folder."""
    path = scratch_path(spark, "service_log")
    render(AP.service_records(load_access(spark, d))).write.text(path)
    return path


def _json_log(spark, d):
    return AP.read_json_log(spark, _files(spark, d, AP.render_record_json))


def _told():
    return [F.element_at("fields", "operation").alias("operation"),
            F.element_at("fields", "business_event").alias("business_event"),
            F.element_at("fields", "duration_ms").try_cast("bigint").alias("duration_ms")]


@register("service_log_json_files", _sql(_ROW.format(stamp="%Y-%m-%dT%H:%M:%SZ", more="")))
def _service_log_json_files(spark, d):
    return _json_log(spark, d).select(*_COLUMNS, *_told())


@register("service_log_text_files", _sql(_ROW.format(
    stamp="%Y-%m-%d %H:%M:%S", more=", 'store.go' AS file, 48 AS line, 'StoreLog' AS function")))
def _service_log_text_files(spark, d):
    read = AP.read_text_log(spark, _files(spark, d, AP.render_record_text))
    return read.select(*_COLUMNS, *_told(), "file", "line", "function")


@register("span_durations", _sql(
    f"""SELECT operation, status, count(*) AS count, {R('avg(ms)')} AS avg_duration_ms, {R('max(ms) * 1.0')} AS max_duration_ms,
 {R('max(ms) FILTER (WHERE k = n // 2) * 1.0')} AS p50_duration_ms,
 {R('max(ms) FILTER (WHERE k = LEAST(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1)) * 1.0')} AS p95_duration_ms,
 {R('max(ms) FILTER (WHERE k = LEAST(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1)) * 1.0')} AS p99_duration_ms
FROM (SELECT *, row_number() OVER (PARTITION BY operation, status ORDER BY ms) - 1 AS k,
       count(*) OVER (PARTITION BY operation, status) AS n FROM rec WHERE status IS NOT NULL) GROUP BY operation, status"""))
def _span_durations(spark, d):
    return AP.span_durations(_json_log(spark, d))


@register("database_operations", _sql(
    f"""SELECT operation, table_name, count(*) AS count, count(*) FILTER (WHERE ms > 100) AS slow, {R('avg(ms)')} AS avg_duration_ms
FROM rec WHERE table_name IS NOT NULL GROUP BY operation, table_name"""))
def _database_operations(spark, d):
    return AP.database_operations(_json_log(spark, d))


@register("business_events", _sql(
    """SELECT event AS business_event, count(*) AS count, count(DISTINCT id) AS entities
FROM rec WHERE event IS NOT NULL GROUP BY event"""))
def _business_events(spark, d):
    return AP.business_events(_json_log(spark, d))


@register("service_log_tracebacks", _sql(_ROW.format(
    stamp="%Y-%m-%d %H:%M:%S", more=""", CASE WHEN level = 'WARN' THEN 'Traceback (most recent call last):' || chr(10) ||
 '  File "store.go", line 48, in StoreLog' || chr(10) || chr(10) || '[retry] WARN [store]' || chr(10) ||
 'store.TimeoutError: insert req-' || CAST(id AS VARCHAR) || ' took too long' END AS traceback,
 CASE WHEN level = 'WARN' THEN 'store.TimeoutError' END AS exception_type,
 CASE WHEN level = 'WARN' THEN 'insert req-' || CAST(id AS VARCHAR) || ' took too long' END AS exception_message""")))
def _service_log_tracebacks(spark, d):
    """Text files whose warnings carry tracebacks over several lines."""
    path = _files(spark, d, lambda records: AP.render_record_text(AP.with_tracebacks(records)))
    return AP.read_text_log(spark, path).select(*_COLUMNS, *_told(), "traceback", "exception_type", "exception_message")
