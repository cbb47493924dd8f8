"""Registered queries: recommendations, alerts, report, streaming jobs."""

from __future__ import annotations

import os

from ..sinks.scratch import scratch_path
from ..sources import tables as TB
from ..streaming import jobs as ST
from . import report as RP
from . import sqlbits as S
from .catalog import MAX_TS, ORACLE as _ORACLE, R, _logs, register
from .catalog_ingest import _ROUTED
from .oracle_values import SECURITY_RULES

_RT = f"{S.response_time('message')}"
_HIGH = f"""high_anoms AS (
 SELECT 'high_error_rate' AS type FROM (SELECT source, count(*) AS t, count(*) FILTER (WHERE {S.NARROW}) * 100.0 / count(*) AS r
   FROM logs GROUP BY source) WHERE r > 20 AND t > 5 AND r > 50
 UNION ALL
 SELECT 'frequent_error_pattern' FROM pc, (SELECT count(*) AS n_patterns, avg(count) + 2.0 * stddev_samp(count) AS threshold FROM pc) st
   WHERE n_patterns > 1 AND count > threshold AND count > 3 AND count > threshold * 2),
ef AS (SELECT avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END) AS error_rate FROM logs),
slow AS (SELECT count(*) AS n FROM logs WHERE {_RT} > 5000)"""
_PC = "pc AS (SELECT pattern, count(*) AS count FROM elogs WHERE is_narrow_error AND pattern <> '' GROUP BY pattern)"

_FIRED = f"""fired AS (
 SELECT 1 AS rank, printf({S.q(RP.REC_ERROR_RATE)}, error_rate) AS recommendation FROM ef WHERE error_rate > 10
 UNION ALL
 SELECT 2, printf({S.q(RP.REC_TOP_SOURCE)}, source, c) FROM (
   SELECT source, count(*) AS c FROM logs WHERE {S.BROAD} GROUP BY source ORDER BY c DESC, source LIMIT 1) WHERE c > 5
 UNION ALL
 SELECT 3, printf({S.q(RP.REC_ANOMALY)}, type) FROM high_anoms
 UNION ALL
 SELECT 4, printf({S.q(RP.REC_SLOW)}, n) FROM slow WHERE n > 5)"""


@register("recommendations", S.with_views(
    f"""SELECT rank, recommendation FROM fired
UNION ALL SELECT 5, {S.q(RP.REC_DEFAULT)} WHERE (SELECT count(*) FROM fired) = 0""",
    enriched=True, extra=",\n".join([_PC, _HIGH, _FIRED])))
def _recommendations(spark, d):
    return RP.recommendations(_logs(spark, d))


_SEC = ", ".join(f"({S.q(p)})" for t in ("suspicious", "injection") for p in SECURITY_RULES[t])


@register("alerts", S.with_views(
    f"""SELECT {MAX_TS} AS alert_ts, rule, message, {R('value')} AS value, {R('threshold')} AS threshold FROM (
 SELECT 'error_rate' AS rule, printf({S.q(RP.ALERT_ERROR_RATE)}, error_rate) AS message, error_rate AS value, 5.0 AS threshold
   FROM ef WHERE error_rate > 5
 UNION ALL
 SELECT 'high_severity_anomalies', printf({S.q(RP.ALERT_ANOMALIES)}, n), n * 1.0, 0.0
   FROM (SELECT count(*) AS n FROM high_anoms) WHERE n > 0
 UNION ALL
 SELECT 'security_threats', printf({S.q(RP.ALERT_THREATS)}, n), n * 1.0, 0.0 FROM (
   SELECT count(*) AS n FROM (SELECT DISTINCT l.id, p.t FROM logs l JOIN (VALUES {_SEC}) AS s(phrase)
     ON contains(lower(l.message), s.phrase) JOIN (VALUES
     {", ".join(f"({S.q(p)}, {S.q(t)})" for t in ("suspicious", "injection") for p in SECURITY_RULES[t])}) AS p(phrase, t)
     ON p.phrase = s.phrase)) WHERE n > 0
 UNION ALL
 SELECT 'slow_operations', printf({S.q(RP.ALERT_SLOW)}, n), n * 1.0, 10.0 FROM slow WHERE n > 10)""",
    enriched=True, extra=",\n".join([_PC, _HIGH])))
def _alerts(spark, d):
    return RP.alerts(_logs(spark, d))


# the monitoring stream reads the single input file in one micro-batch (batch 0)
ORACLE_ALERTS_FOR_STREAM = _ORACLE["alerts"].replace(
    f"SELECT {MAX_TS} AS alert_ts, rule,", f"SELECT {MAX_TS} AS alert_ts, 0 AS batch_id, rule,", 1)


@register("report")
def _report(spark, d):
    """The comprehensive analysis as one row of nested structs."""
    return RP.report(_logs(spark, d))


@register("report_json")
def _report_json(spark, d):
    return RP.report_json(_logs(spark, d))


# ------------------------------------------------------------ streaming -----
def _events_stream(spark, d):
    schema = TB.read_table(spark, d, "events").schema
    return ST.read_table_stream(spark, os.path.join(d, "events.parquet"), schema)


@register("stream_ingest", S.with_views("SELECT * FROM acc", logs=False, raw=True, extra=_ROUTED))
def _stream_ingest(spark, d):
    """Continuous ingest run to completion (availableNow); accepted rows."""
    out, ck = scratch_path(spark, "stream_ingest_out"), scratch_path(spark, "stream_ingest_ckpt")
    q = ST.ingest_stream(TB.raw_events_from_events(_events_stream(spark, d)), out, ck)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/accepted").drop("batch_id")


@register("stream_window_counts", S.with_views(
    f"""SELECT window_start, window_start + INTERVAL 10 MINUTE AS window_end, count(*) AS volume,
 count(*) FILTER (WHERE {S.NARROW}) AS error_count
FROM (SELECT *, time_bucket(INTERVAL '10 minutes', log_ts) AS window_start FROM logs)
GROUP BY window_start HAVING window_start + INTERVAL 10 MINUTE <= {MAX_TS} - INTERVAL 10 MINUTE"""))
def _stream_window_counts(spark, d):
    """10-minute windows with a 10-minute watermark, appended once final."""
    out, ck = scratch_path(spark, "stream_windows_out"), scratch_path(spark, "stream_windows_ckpt")
    q = ST.window_counts_stream(TB.logs_from_events(_events_stream(spark, d)), out, ck)
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_rate_limit", S.with_views(
    f"""SELECT http_remote_addr, window_start, count(*) AS requests, LEAST(count(*), 50) AS ok,
 LEAST(GREATEST(count(*) - 50, 0), 50) AS high_rate, GREATEST(count(*) - 100, 0) AS rejected
FROM (SELECT *, time_bucket(INTERVAL '1 day', log_ts) AS window_start FROM access)
GROUP BY 1, 2 HAVING window_start + INTERVAL 1 DAY <= (SELECT max(log_ts) FROM access) - INTERVAL 1 HOUR""",
    logs=False, access=True))
def _stream_rate_limit(spark, d):
    """Per-client daily windows (1-hour watermark) with the rate classes."""
    out, ck = scratch_path(spark, "stream_rate_out"), scratch_path(spark, "stream_rate_ckpt")
    q = ST.rate_limit_stream(TB.access_from_events(_events_stream(spark, d)), out, ck, window="1 day", delay="1 hour")
    q.awaitTermination()
    return spark.read.parquet(out)


def _monitor(spark, d):
    out, ck = scratch_path(spark, "stream_monitor_out"), scratch_path(spark, "stream_monitor_ckpt")
    q = ST.monitor_stream(TB.logs_from_events(_events_stream(spark, d)), out, ck)
    q.awaitTermination()
    return out


_ANOMS = f"""anoms AS (
 SELECT source FROM (SELECT source, count(*) AS t, count(*) FILTER (WHERE {S.NARROW}) * 100.0 / count(*) AS r
   FROM logs GROUP BY source) WHERE r > 20 AND t > 5
 UNION ALL
 SELECT pattern FROM pc, (SELECT count(*) AS n_patterns, avg(count) + 2.0 * stddev_samp(count) AS threshold FROM pc) st
   WHERE n_patterns > 1 AND count > threshold AND count > 3)"""


@register("stream_monitor", S.with_views(
    f"""SELECT count(*) AS total_logs, count(*) FILTER (WHERE {S.BROAD}) AS total_errors,
 {R(f"avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END)")} AS error_rate,
 CASE WHEN avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END) < 1 THEN 'excellent'
      WHEN avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END) < 5 THEN 'good'
      WHEN avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END) < 15 THEN 'warning' ELSE 'critical' END AS health_status,
 (SELECT count(*) FROM anoms) AS anomalies, 0 AS batch_id FROM logs""",
    enriched=True, extra=",\n".join([_PC, _ANOMS])))
def _stream_monitor(spark, d):
    """Per micro-batch status line of the monitoring stream."""
    return spark.read.parquet(f"{_monitor(spark, d)}/status")


@register("stream_alerts", ORACLE_ALERTS_FOR_STREAM)
def _stream_alerts(spark, d):
    """Alerts raised by the monitoring stream, per micro-batch."""
    return spark.read.parquet(f"{_monitor(spark, d)}/alerts")
