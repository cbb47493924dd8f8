"""SQL text used by the independent DuckDB oracle of each registered query.

The oracle re-derives every result from the stored tables with plain SQL,
so agreement with the Spark plan is a real check, not a tautology.
"""

from __future__ import annotations

from .oracle_values import (ERROR_PATTERN_RULES, RESPONSE_TIME_PATTERNS, SIGNATURE_RULES, SIGNATURE_STOP_WORDS,
                            TERM_STOP_WORDS)

# The three views of the test fixtures, derived from ``events``.
LOGS_SQL = """SELECT event_id AS id, ts AS log_ts,
 CASE user_id % 8 WHEN 0 THEN 'database_service' WHEN 1 THEN 'auth_service' WHEN 2 THEN 'api_service'
   WHEN 3 THEN 'system_monitor' WHEN 4 THEN 'backup_service' WHEN 5 THEN 'security_service'
   WHEN 6 THEN 'cache_service' ELSE 'unknown' END AS source,
 CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'fatal' WHEN event_type = 'error' THEN 'error'
   WHEN user_id % 8 = 0 AND event_type IN ('click','view') THEN 'error'
   WHEN user_id % 8 = 2 AND event_type = 'click' THEN 'error'
   WHEN event_type = 'signup' THEN 'warn' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END AS level,
 CASE event_id % 7
  WHEN 0 THEN 'Database connection failed after ' || CAST(event_id % 5 AS STRING) || ' retries'
  WHEN 1 THEN 'Request timeout while processing /api/users (took ' || CAST(CAST(FLOOR(value*20) AS BIGINT) AS STRING) || 'ms)'
  WHEN 2 THEN 'Failed login attempt for user admin from IP 192.168.1.' || CAST(user_id % 255 AS STRING)
  WHEN 3 THEN 'User authentication successful for user_' || CAST(user_id AS STRING)
  WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN 'SQL injection attempt detected in parameter ' || CAST(user_id AS STRING)
              ELSE 'Permission denied for object deadbeef' || CAST(1000 + event_id % 9 AS STRING) END
  WHEN 5 THEN 'Cache cleared successfully, duration: ' || CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) || 's'
  ELSE 'Disk space usage at ' || CAST(event_id % 100 AS STRING) || '% on server-01' END AS message
FROM events"""

RAW_EVENTS_SQL = """SELECT event_id AS id, CASE event_id % 9
 WHEN 0 THEN '{"log":"legacy entry ' || CAST(event_id AS STRING) || '"}'
 WHEN 1 THEN '{"invalid":"format"}'
 WHEN 2 THEN 'invalid json'
 WHEN 3 THEN '{"message":"","level":"info"}'
 WHEN 4 THEN '{"message":"no level"}'
 WHEN 5 THEN '{"message":"mixed case","level":"Warn"}'
 WHEN 6 THEN '{"message":"no source","level":"ERROR","timestamp":"2024-01-15T10:30:00Z"}'
 WHEN 7 THEN '{"message":"bad time","level":"warn","timestamp":"2024-01-15 10:30:00"}'
 ELSE '{"message":"ok ' || CAST(event_id AS STRING) || '","level":"debug","source":"db-service","timestamp":"2024-01-15T10:31:00Z"}' END AS payload
FROM events"""

ACCESS_SQL = """SELECT event_id AS id, ts AS log_ts, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS http_method,
 CASE event_id % 5 WHEN 0 THEN '/health' WHEN 1 THEN '/logs' WHEN 2 THEN '/ingest' WHEN 3 THEN '/a%20b' ELSE '/healthz' END AS http_path,
 CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 400 ELSE 202 END AS http_status_code,
 CAST(FLOOR(value*40) AS BIGINT) AS duration_ms, '10.0.0.' || CAST(user_id % 3 AS STRING) AS http_remote_addr,
 CASE WHEN event_id % 11 = 0 THEN '' ELSE 'curl/8' END AS http_user_agent
FROM events"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(expr: str, rules) -> str:
    for pat, rep in rules:
        expr = f"regexp_replace({expr}, {q(pat)}, {q(rep)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def error_pattern(m: str = "message") -> str:
    return strip(_chain(f"COALESCE({m}, '')", ERROR_PATTERN_RULES))


def _in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def message_signature(m: str = "message") -> str:
    norm = _chain(f"lower(COALESCE({m}, ''))", SIGNATURE_RULES)
    words = f"regexp_extract_all({norm}, '\\b[a-zA-Z]{{3,}}\\b')"
    kept = f"list_filter({words}, lambda w: w NOT IN {_in_list(SIGNATURE_STOP_WORDS)})"
    return f"array_to_string(list_slice({kept}, 1, 5), ' ')"


def cluster_signature(m: str = "message") -> str:
    words = f"regexp_extract_all(lower(COALESCE({m}, '')), '\\b[a-zA-Z]{{4,}}\\b')"
    return f"array_to_string(list_slice(list_sort(list_distinct({words})), 1, 3), ' ')"


def terms(m: str = "message") -> str:
    words = f"regexp_extract_all(lower(COALESCE({m}, '')), '\\b[a-zA-Z]{{3,}}\\b')"
    return f"list_filter({words}, lambda w: w NOT IN {_in_list(TERM_STOP_WORDS)})"


def response_time(m: str = "message", unit_mode: str = "intended") -> str:
    parts = []
    for pat in RESPONSE_TIME_PATTERNS:
        scale = 1000.0 if (unit_mode == "reference" or "duration" in pat) else 1.0
        ext = f"regexp_extract({m}, {q('(?i)' + pat)}, 1)"
        parts.append(f"CASE WHEN {ext} <> '' THEN CAST({ext} AS DOUBLE) * {scale} END")
    return f"NULLIF(COALESCE({', '.join(parts)}), 0)"


def severity_weight(lv: str = "level") -> str:
    return (f"CASE {lv} WHEN 'fatal' THEN 10.0 WHEN 'error' THEN 5.0 WHEN 'warn' THEN 2.0 "
            f"WHEN 'info' THEN 1.0 WHEN 'debug' THEN 0.5 ELSE 1.0 END")


BROAD = "level IN ('error', 'fatal', 'warn')"
NARROW = "level IN ('error', 'fatal')"


def enriched_cte(unit_mode: str = "intended") -> str:
    """``elogs``: the logs view plus every derived column (oracle side)."""
    return f"""elogs AS (
 SELECT *, {error_pattern()} AS pattern, {message_signature()} AS signature,
  {cluster_signature()} AS cluster, {response_time('message', unit_mode)} AS response_time,
  {BROAD} AS is_broad_error, {NARROW} AS is_narrow_error, {severity_weight()} AS severity_weight,
  CAST(hour(log_ts) AS BIGINT) AS hour, strftime(log_ts, '%Y-%m-%d') AS day
 FROM logs)"""


def with_views(body: str, *, logs: bool = True, raw: bool = False, access: bool = False,
               enriched: bool = False, extra: str = "", unit_mode: str = "intended") -> str:
    ctes = []
    if logs or enriched:
        ctes.append(f"logs AS ({LOGS_SQL})")
    if raw:
        ctes.append(f"raw_events AS ({RAW_EVENTS_SQL})")
    if access:
        ctes.append(f"access AS ({ACCESS_SQL})")
    if enriched:
        ctes.append(enriched_cte(unit_mode))
    if extra:
        ctes.append(extra)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
