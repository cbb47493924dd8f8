"""Queries over tables that the engine stores: report history, the written
log table, payloads with field names in any case, and anomaly episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes as EP
from ..sinks import writers as W
from ..sinks.scratch import scratch_path
from ..sources import ingest as IG
from ..sources.tables import read_table
from . import history as H
from . import sqlbits as S
from .catalog import R, _logs, register
from .oracle_values import RFC3339

# ------------------------------------------------------------- history -----
_RT = S.response_time("message")
_HISTORY = f"""l AS (SELECT *, CAST(log_ts AS DATE) AS day, {_RT} AS rt, {S.severity_weight()} AS weight, {S.BROAD} AS bad FROM logs),
days AS (SELECT DISTINCT day FROM l),
runs AS (SELECT d.day, count(*) AS total_logs, count(*) FILTER (WHERE bad) AS total_errors, avg(CASE WHEN bad THEN 100.0 ELSE 0.0 END) AS error_rate,
  avg(weight) AS severity_score, count(DISTINCT source) AS source_count, avg(rt) AS average_response_time,
  count(*) FILTER (WHERE rt > 5000) AS slow_operations FROM days d JOIN l ON l.day <= d.day GROUP BY d.day),
spread AS (SELECT day, avg(c) AS volume_mean, COALESCE(stddev_samp(c), 0.0) AS volume_std FROM (
  SELECT d.day, hour(log_ts) AS h, count(*) AS c FROM days d JOIN l ON l.day <= d.day GROUP BY 1, 2) GROUP BY day),
scored AS (SELECT *, GREATEST(0.0, 40.0 - error_rate * 2) + GREATEST(0.0, 20.0 - severity_score)
  + CASE WHEN volume_std > 0 THEN GREATEST(0.0, 20.0 - volume_std / volume_mean * 10) ELSE 20.0 END + LEAST(20.0, source_count * 2.0) AS score
 FROM runs JOIN spread USING (day))"""


@register("report_history", S.with_views(
    f"""SELECT day, total_logs, total_errors, {R('error_rate')} AS error_rate, {R('severity_score')} AS severity_score, source_count,
 {R('average_response_time')} AS average_response_time, slow_operations, {R('score')} AS score,
 CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
 {R('error_rate - lag(error_rate) OVER (ORDER BY day)')} AS error_rate_change, {R('score - lag(score) OVER (ORDER BY day)')} AS score_change,
 total_logs - COALESCE(lag(total_logs) OVER (ORDER BY day), 0) AS new_logs FROM scored""", extra=_HISTORY))
def _report_history(spark, d):
    """The report's figures at the end of every stored day, from a history
    table; the newest day is written a second time, as after late logs."""
    logs, path = _logs(spark, d), scratch_path(spark, "report_history")
    H.refresh(logs, path)
    newest = logs.agg(F.max("log_ts")).first()[0]
    if newest is not None:
        H.refresh(logs, path, [newest.date()])
    return H.runs(spark, path)


# ---------------------------------------------------------------- sink -----
@register("stored_logs", S.with_views("SELECT id, log_ts, level, message, source, CAST(log_ts AS DATE) AS date FROM logs"))
def _stored_logs(spark, d):
    """The log table written in two units, one of them twice, and read back."""
    logs, path = _logs(spark, d), scratch_path(spark, "stored_logs")
    for unit, rest in (("even", 0), ("odd", 1), ("even", 0)):
        W.write_logs(logs.filter(F.col("id") % 2 == rest), path, unit=unit)
    return W.read_written_logs(spark, path).select("id", "log_ts", "level", "message", "source", "date")


# ----------------------------------------------- field names in any case -----
_CASED = """SELECT event_id AS id, CASE event_id % 6
 WHEN 0 THEN '{"message":"m ' || CAST(event_id AS STRING) || '","Level":"INFO"}'
 WHEN 1 THEN '{"message":"low","MESSAGE":"high","level":"warn","LEVEL":"bad"}'
 WHEN 2 THEN '{"MESSAGE":"kept","message":null,"level":"error","Source":"db","SOURCE":"other"}'
 WHEN 3 THEN '{"message":"typed","level":"info","Source":' || CAST(event_id AS STRING) || '}'
 WHEN 4 THEN '{"MESSAGE":"no exact name","level":"info"}'
 ELSE '{"message":"timed","Level":"debug","TimeStamp":"2024-01-15T10:30:00Z","Timestamp":null}' END AS payload
FROM events"""


@register("ingest_any_case", f"""WITH cased AS ({_CASED}),
named AS (SELECT id, payload, unnest(json_keys(payload)) AS name FROM cased),
typed AS (SELECT id, lower(name) AS field, name, json_type(payload, '$."' || name || '"') AS t,
  json_extract_string(payload, '$."' || name || '"') AS v FROM named),
last AS (SELECT id, field, bool_and(CASE WHEN field = 'id' THEN t IN ('NULL', 'BIGINT', 'UBIGINT')
    WHEN field = 'timestamp' THEN t = 'NULL' OR (t = 'VARCHAR' AND regexp_full_match(v, {S.q(RFC3339[1:-1])})) ELSE t IN ('NULL', 'VARCHAR') END) AS good,
  bool_or(name = field) AS exact, arg_max(v, name) FILTER (WHERE t <> 'NULL') AS v FROM typed
  WHERE field IN ('id', 'timestamp', 'level', 'message', 'source') GROUP BY id, field),
flat AS (SELECT id, bool_and(good) AS good, bool_or(exact AND field = 'message') AS structured, max(v) FILTER (WHERE field = 'message') AS message,
  max(v) FILTER (WHERE field = 'level') AS level, COALESCE(NULLIF(max(v) FILTER (WHERE field = 'source'), ''), 'unknown') AS source,
  max(v) FILTER (WHERE field = 'timestamp') AS ts FROM last GROUP BY id),
judged AS (SELECT *, CASE WHEN NOT structured THEN {S.q(IG.MISSING_FIELDS)} WHEN NOT good THEN {S.q(IG.INVALID_STRUCTURED)}
  WHEN COALESCE(message, '') = '' THEN {S.q(IG.EMPTY_MESSAGE)}
  WHEN COALESCE(level, '') NOT IN ('DEBUG','INFO','WARN','ERROR','FATAL','debug','info','warn','error','fatal') THEN {S.q(IG.INVALID_LEVEL)} END AS reason FROM flat)
SELECT id, reason, CASE WHEN reason IS NULL THEN message END AS message, CASE WHEN reason IS NULL THEN level END AS level,
 CASE WHEN reason IS NULL THEN source END AS source,
 CASE WHEN reason IS NULL THEN COALESCE(timezone('UTC', CAST(ts AS TIMESTAMPTZ)), TIMESTAMP '{IG.DEFAULT_INGEST_TS}') END AS log_ts FROM judged""")
def _ingest_any_case(spark, d):
    """Routing of payloads whose field names differ in case."""
    events = read_table(spark, d, "events")
    routed = IG.route_payloads(events.selectExpr("event_id AS id", f"({_CASED[len('SELECT event_id AS id, '):-len(' AS payload' + chr(10) + 'FROM events')]}) AS payload"))
    ok = F.col("reason").isNull()
    return routed.select("id", "reason", *[F.when(ok, F.col(c)).alias(c) for c in ("message", "level", "source", "log_ts")])


# ------------------------------------------------------------ episodes -----
_EPISODES = f"""l AS (SELECT *, {S.NARROW} AS bad FROM logs WHERE log_ts IS NOT NULL),
win AS (SELECT time_bucket(INTERVAL '10 minutes', log_ts) AS started, count(*) AS volume, count(*) FILTER (WHERE bad) AS errors,
  count(*) FILTER (WHERE bad) * 1.0 / count(*) AS rate FROM l GROUP BY 1),
st AS (SELECT CAST(started AS DATE) AS day, count(*) AS n, avg(volume) AS vm, stddev_pop(volume) AS vs, avg(rate) AS rm, stddev_pop(rate) AS rs
 FROM win GROUP BY 1 HAVING count(*) >= 3),
z AS (SELECT win.*, CASE WHEN vs > 0 THEN (volume - vm) / vs END AS vz, CASE WHEN rs > 0 THEN (rate - rm) / rs END AS rz
 FROM win JOIN st ON CAST(started AS DATE) = day),
det AS (
 SELECT CASE WHEN vz > 0 THEN 'temporal_volume_spike' ELSE 'temporal_volume_drop' END AS type, NULL AS source, started,
  started + INTERVAL 10 MINUTE AS ended, volume AS count, LEAST(abs(vz) / 3.0, 1.0) AS confidence FROM z WHERE abs(vz) > 2
 UNION ALL SELECT 'temporal_error_spike', NULL, started, started + INTERVAL 10 MINUTE, errors, LEAST(abs(rz) / 3.0, 1.0) FROM z WHERE rz > 2
 UNION ALL SELECT 'high_error_rate', source, CAST(day AS TIMESTAMP), CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, errors, errors * 1.0 / n FROM (
  SELECT source, CAST(log_ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE bad) AS errors FROM l GROUP BY 1, 2) WHERE n > 5 AND errors * 1.0 / n > 0.2),
reach AS (SELECT *, max(ended) OVER (PARTITION BY type, source ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM det),
isl AS (SELECT *, sum(CASE WHEN upto IS NULL OR started > upto + INTERVAL 1 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY type, source ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM reach)"""


@register("anomaly_episodes", S.with_views(
    f"""SELECT type, source, min(started) AS started, max(ended) AS ended, CAST(sum(count) AS BIGINT) AS count,
 {R('max(confidence)')} AS confidence, CASE WHEN count(*) > 1 THEN count(*) END AS merged_count FROM isl GROUP BY type, source, episode""",
    extra=_EPISODES))
def _anomaly_episodes(spark, d):
    return EP.anomaly_episodes(_logs(spark, d))
