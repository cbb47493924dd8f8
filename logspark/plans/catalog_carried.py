"""Queries of the streams that carry state, over the events table dealt to
many files so that they run in several micro-batches."""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import functions as F

from ..sinks.scratch import scratch_path
from ..sources import tables as TB
from ..sources.scans import ts_lit
from ..streaming import carried as CS
from ..streaming import jobs as ST
from . import sqlbits as S
from .catalog import R, register

PARTS = 4


def dealt(spark, d, parts: int = PARTS) -> str:
    """The events table as a folder of files written one after the other: the
    k-th holds the ids that leave k when divided by ``parts``."""
    path = os.path.join(scratch_path(spark, "dealt_events"), "events.parquet")
    events = TB.read_table(spark, d, "events")
    for k in range(parts):
        events.filter(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark, path):
    return ST.read_table_stream(spark, path, spark.read.parquet(path).schema, max_files=1)


@register("stream_rate_limit_requests", S.with_views(
    """SELECT id, http_remote_addr, window_start, request_number,
 CASE WHEN request_number > 100 THEN 'rejected' WHEN request_number > 50 THEN 'high_rate' ELSE 'ok' END AS decision
FROM (SELECT id, http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) AS window_start,
  row_number() OVER (PARTITION BY http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) ORDER BY log_ts, id) AS request_number
 FROM access)""", logs=False, access=True))
def _stream_rate_limit_requests(spark, d):
    """Per-request decisions in daily windows over files whose requests are
    out of order by up to the whole table: the delay covers it, so what has
    not been released at the end is numbered from the state."""
    out = scratch_path(spark, "stream_requests")
    access = TB.access_from_events(_stream(spark, dealt(spark, d)))
    CS.request_decisions_stream(access, f"{out}/out", f"{out}/ck", window="1 day", delay=_dt.timedelta(days=36500)).awaitTermination()
    return CS.request_decisions(spark, f"{out}/out", window="1 day", waiting=True)


@register("stream_rate_limit_in_order", S.with_views(
    """SELECT id, http_remote_addr, window_start, request_number,
 CASE WHEN request_number > 100 THEN 'rejected' WHEN request_number > 50 THEN 'high_rate' ELSE 'ok' END AS decision
FROM (SELECT id, log_ts, http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) AS window_start,
  row_number() OVER (PARTITION BY http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) ORDER BY log_ts, id) AS request_number
 FROM access) WHERE log_ts <= (SELECT max(log_ts) FROM access) - INTERVAL 10 MINUTE""", logs=False, access=True))
def _stream_rate_limit_in_order(spark, d):
    """The same over files in order of time with a delay of 10 minutes: the
    decisions that the stream has released."""
    path = os.path.join(scratch_path(spark, "ordered_events"), "events.parquet")
    events = TB.read_table(spark, d, "events")
    cuts = events.agg(*[F.min("ts").alias("lo"), F.max("ts").alias("hi")]).first()
    step = (cuts["hi"] - cuts["lo"]) / PARTS
    for k in range(PARTS):
        lo, hi = cuts["lo"] + k * step, cuts["lo"] + (k + 1) * step
        mine = (F.col("ts") >= ts_lit(lo)) if k else F.lit(True)
        mine = mine & (F.col("ts") < ts_lit(hi)) if k < PARTS - 1 else mine
        events.filter(mine).coalesce(1).write.mode("append").parquet(path)
    out = scratch_path(spark, "stream_requests")
    access = TB.access_from_events(_stream(spark, path))
    CS.request_decisions_stream(access, f"{out}/out", f"{out}/ck", window="1 day", delay=_dt.timedelta(minutes=10)).awaitTermination()
    return CS.request_decisions(spark, f"{out}/out")


_RECENT = f"""recent AS (SELECT k.b AS batch_id, l.*, {S.response_time('l.message')} AS rt
 FROM range({PARTS}) k(b) JOIN logs l ON l.id % {PARTS} <= k.b
 QUALIFY row_number() OVER (PARTITION BY k.b ORDER BY log_ts DESC NULLS LAST, id DESC) <= 100)"""
_RECENT_SQL = f"""SELECT CAST(batch_id AS INTEGER) AS batch_id, count(*) AS total_logs_analyzed,
 strftime(min(log_ts), '%Y-%m-%dT%H:%M:%S') || ' to ' || strftime(max(log_ts), '%Y-%m-%dT%H:%M:%S') AS time_range,
 count(*) FILTER (WHERE {S.BROAD}) AS total_errors, {R(f"avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END)")} AS error_rate,
 {R(f"avg({S.severity_weight()})")} AS severity_score, count(DISTINCT source) AS source_count,
 count(rt) AS timed_operations, {R("avg(rt)")} AS average_response_time,
 count(*) FILTER (WHERE rt > 5000) AS slow_operations FROM recent GROUP BY batch_id"""


@register("stream_monitor_recent", S.with_views(_RECENT_SQL, extra=_RECENT))
def _stream_monitor_recent(spark, d):
    """The report on the newest 100 rows after every batch of four."""
    out = scratch_path(spark, "stream_recent")
    logs = TB.logs_from_events(_stream(spark, dealt(spark, d)))
    CS.recent_report_stream(logs, f"{out}/out", f"{out}/ck").awaitTermination()
    r = spark.read.parquet(f"{out}/out/reports")
    return r.select("batch_id", "summary.total_logs_analyzed", "summary.time_range", "error_analysis.total_errors",
                    "error_analysis.error_rate", "error_analysis.severity_score", "reliability_score.source_count",
                    "performance_analysis.timed_operations", "performance_analysis.average_response_time",
                    "performance_analysis.slow_operations")
