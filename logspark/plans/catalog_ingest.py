"""Registered queries: ingest validation, text ingest, service logs, access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as AC
from ..sources import applog as AP
from ..sources import ingest as IG
from ..sources.tables import load_access, load_raw_events, read_table
from . import sqlbits as S
from .oracle_values import PATH_SAFE, RFC3339
from .catalog import R, register

_RFC = RFC3339
_NOW = f"TIMESTAMP '{IG.DEFAULT_INGEST_TS}'"


def _jt(f):
    return f"json_type(jo, '$.{f}')"


def _js(f):
    return f"json_extract_string(jo, '$.{f}')"


def _str_ok(t):
    return f"({t} IS NULL OR {t} IN ('VARCHAR', 'NULL'))"


_ROUTED = f"""p0 AS (SELECT id, payload, CASE WHEN json_valid(payload) THEN payload ELSE 'false' END AS jp FROM raw_events),
p1 AS (SELECT id, payload, json_type(jp) = 'OBJECT' AS is_obj, json_type(jp) = 'NULL' AS is_null_doc,
  CASE WHEN json_type(jp) = 'OBJECT' THEN jp ELSE '{{}}' END AS jo FROM p0),
p2 AS (SELECT *, list_contains(json_keys(jo), 'message') AS has_msg,
  list_contains(json_keys(jo), 'log') AS has_log,
  {_jt('message')} AS t_msg, {_jt('level')} AS t_lvl, {_jt('source')} AS t_src, {_jt('id')} AS t_id,
  {_jt('timestamp')} AS t_ts, {_jt('log')} AS t_log,
  COALESCE({_js('message')}, '') AS msg, COALESCE({_js('level')}, '') AS lvl,
  COALESCE(NULLIF(COALESCE({_js('source')}, ''), ''), 'unknown') AS src, {_js('timestamp')} AS ts_s,
  {_js('log')} AS log_s FROM p1),
p3 AS (SELECT *, is_obj AND has_msg AS structured, is_obj AND NOT has_msg AND has_log AS legacy,
  t_ts IS NOT NULL AND t_ts <> 'NULL' AS ts_given,
  {_str_ok('t_msg')} AND {_str_ok('t_lvl')} AND {_str_ok('t_src')}
  AND (t_id IS NULL OR t_id IN ('NULL', 'BIGINT', 'UBIGINT'))
  AND (t_ts IS NULL OR t_ts = 'NULL' OR (t_ts = 'VARCHAR' AND regexp_full_match(ts_s, {S.q(_RFC[1:-1])})
       AND try_cast(ts_s AS TIMESTAMPTZ) IS NOT NULL)) AS types_ok FROM p2),
routed AS (SELECT *, CASE
   WHEN NOT is_obj AND NOT is_null_doc THEN {S.q(IG.INVALID_JSON)}
   WHEN structured AND NOT types_ok THEN {S.q(IG.INVALID_STRUCTURED)}
   WHEN structured AND msg = '' THEN {S.q(IG.EMPTY_MESSAGE)}
   WHEN structured AND lvl NOT IN ('DEBUG','INFO','WARN','ERROR','FATAL','debug','info','warn','error','fatal') THEN {S.q(IG.INVALID_LEVEL)}
   WHEN structured AND length(src) > 100 THEN {S.q(IG.STORE_FAILED)}
   WHEN legacy AND t_log <> 'VARCHAR' THEN {S.q(IG.HANDLER_FAILED)}
   WHEN legacy AND COALESCE(log_s, '') = '' THEN {S.q(IG.EMPTY_MESSAGE)}
   WHEN NOT structured AND NOT legacy THEN {S.q(IG.MISSING_FIELDS)} END AS reason FROM p3),
acc AS (SELECT id,
  CASE WHEN structured AND ts_given THEN timezone('UTC', CAST(ts_s AS TIMESTAMPTZ)) ELSE {_NOW} END AS log_ts,
  CASE WHEN structured THEN lvl ELSE 'info' END AS level, CASE WHEN structured THEN msg ELSE log_s END AS message,
  CASE WHEN structured THEN src ELSE 'legacy_api' END AS source,
  CASE WHEN structured THEN 'structured' ELSE 'legacy' END AS route FROM routed WHERE reason IS NULL)"""


def _routed(spark, d):
    return IG.route_payloads(load_raw_events(spark, d))


@register("ingest_accepted", S.with_views("SELECT * FROM acc", logs=False, raw=True, extra=_ROUTED))
def _ingest_accepted(spark, d):
    return IG.accepted(_routed(spark, d))


@register("ingest_rejects", S.with_views(
    "SELECT id, payload, reason FROM routed WHERE reason IS NOT NULL", logs=False, raw=True, extra=_ROUTED))
def _ingest_rejects(spark, d):
    return IG.rejects(_routed(spark, d))


@register("ingest_route_counts", S.with_views(
    "SELECT COALESCE(reason, 'accepted') AS outcome, count(*) AS count FROM routed GROUP BY 1",
    logs=False, raw=True, extra=_ROUTED))
def _ingest_route_counts(spark, d):
    return IG.route_counts(_routed(spark, d))


@register("valid_time_format", S.with_views(
    """SELECT id, payload, regexp_full_match(COALESCE(ts_s, ''), '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') AS valid_time_format
FROM p2""", logs=False, raw=True, extra=_ROUTED))
def _valid_time_format(spark, d):
    raw = load_raw_events(spark, d)
    ts = F.get_json_object(F.col("payload"), "$.timestamp")
    return raw.select("id", "payload", F.coalesce(ts, F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
                      .alias("valid_time_format"))


@register("business_event_counts", S.with_views(
    "SELECT 'log_ingested' AS business_event, level, source, count(*) AS count FROM acc GROUP BY 2, 3",
    logs=False, raw=True, extra=_ROUTED))
def _business_event_counts(spark, d):
    return AC.business_event_counts(IG.accepted(_routed(spark, d)))


def _sniff(m):
    return (f"CASE WHEN contains({m}, 'ERROR') OR contains({m}, 'error') THEN 'error' "
            f"WHEN contains({m}, 'WARN') OR contains({m}, 'warn') THEN 'warn' "
            f"WHEN contains({m}, 'DEBUG') OR contains({m}, 'debug') THEN 'debug' "
            f"WHEN contains({m}, 'FATAL') OR contains({m}, 'fatal') THEN 'fatal' ELSE 'info' END")


@register("text_lines_ingest", S.with_views(
    f"""SELECT doc_id, line_no, {_sniff('message')} AS level, message, 'parse_logs_script' AS source, {_NOW} AS log_ts
FROM (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS message
      FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS parts FROM documents))
WHERE message <> ''""", logs=False))
def _text_lines_ingest(spark, d):
    return IG.text_lines(read_table(spark, d, "documents"))


# ------------------------------------------------------------- access -------
_SEV = "CASE WHEN http_status_code >= 500 THEN 'error' WHEN http_status_code >= 400 THEN 'warn' ELSE 'info' END"
_ACC_COLS = "id, log_ts, http_method, http_path, http_status_code, duration_ms, http_remote_addr, http_user_agent"


@register("access_severity", S.with_views(
    f"SELECT {_SEV} AS severity, count(*) AS requests, {R('avg(duration_ms)')} AS avg_duration_ms FROM access GROUP BY 1",
    logs=False, access=True))
def _access_severity(spark, d):
    return AC.access_severity(load_access(spark, d))


@register("access_slow", S.with_views(
    "SELECT id, log_ts, http_method, http_path, duration_ms FROM access WHERE duration_ms > 5000",
    logs=False, access=True))
def _access_slow(spark, d):
    return AC.access_slow(load_access(spark, d))


@register("access_non_health", S.with_views(
    f"SELECT {_ACC_COLS} FROM access WHERE http_path NOT IN ('/health', '/healthz')", logs=False, access=True))
def _access_non_health(spark, d):
    return AC.access_non_health(load_access(spark, d))


_SAFE = PATH_SAFE


@register("access_suspicious", S.with_views(
    f"""SELECT id, log_ts, http_path, http_remote_addr, COALESCE(http_user_agent, '') = '' AS empty_user_agent,
 NOT regexp_full_match(http_path, {S.q(_SAFE)}) AS url_encoding FROM access
WHERE http_path NOT IN ('/health', '/healthz')
  AND (COALESCE(http_user_agent, '') = '' OR NOT regexp_full_match(http_path, {S.q(_SAFE)}))""",
    logs=False, access=True))
def _access_suspicious(spark, d):
    return AC.access_suspicious(load_access(spark, d))


@register("rate_limit_decisions", S.with_views(
    """SELECT http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) AS window_start, count(*) AS requests,
 LEAST(count(*), 50) AS ok, LEAST(GREATEST(count(*) - 50, 0), 50) AS high_rate,
 GREATEST(count(*) - 100, 0) AS rejected FROM access GROUP BY 1, 2""", logs=False, access=True))
def _rate_limit_decisions(spark, d):
    return AC.rate_limit_decisions(load_access(spark, d), "1 day")


@register("request_ids", S.with_views(
    """SELECT id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS request_id
FROM (SELECT id, sha256('request:' || CAST(id AS VARCHAR)) AS h FROM access)""", logs=False, access=True))
def _request_ids(spark, d):
    return AC.request_ids(load_access(spark, d))


# ------------------------------------------------------- service logs -------
_ENTRY = f"""ent AS (SELECT id, log_ts, {_SEV} AS sev, duration_ms, http_method, http_path, http_remote_addr,
  http_status_code, http_user_agent, 'req-' || CAST(id AS VARCHAR) AS request_id,
  CASE WHEN http_status_code >= 500 THEN {S.q(AP.SERVER_ERROR)} WHEN http_status_code >= 400 THEN {S.q(AP.CLIENT_ERROR)}
       ELSE {S.q(AP.COMPLETED)} END AS message FROM access)"""


def _entries(spark, d):
    return AP.access_entries(load_access(spark, d))


@register("render_app_log", S.with_views(
    """SELECT id, '[' || strftime(log_ts, '%Y-%m-%d %H:%M:%S') || '] ' || upper(sev) || ' [log-ingestion/http] :0  - '
  || message || ' [request=' || request_id || '] fields=' || CAST(json_object('duration_ms', duration_ms,
  'http_method', http_method, 'http_path', http_path, 'http_remote_addr', http_remote_addr,
  'http_status_code', CAST(http_status_code AS BIGINT), 'http_user_agent', http_user_agent) AS VARCHAR) AS line FROM ent""",
    logs=False, access=True, extra=_ENTRY))
def _render_app_log(spark, d):
    return AP.render_text(_entries(spark, d))


@register("app_log_text", S.with_views(
    """SELECT id, strftime(log_ts, '%Y-%m-%d %H:%M:%S') AS timestamp, upper(sev) AS level, 'log-ingestion' AS service,
 'http' AS component, '' AS file, 0 AS line, '' AS function, message, request_id, duration_ms, http_path FROM ent""",
    logs=False, access=True, extra=_ENTRY))
def _app_log_text(spark, d):
    p = AP.parse_text(AP.render_text(_entries(spark, d)))
    return p.select("id", "timestamp", "level", "service", "component", "file", "line", "function", "message",
                    "request_id", F.element_at("fields", "duration_ms").try_cast("bigint").alias("duration_ms"),
                    F.element_at("fields", "http_path").alias("http_path"))


@register("app_log_json", S.with_views(
    """SELECT id, strftime(log_ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, upper(sev) AS level, message,
 'log-ingestion' AS service, 'http' AS component, request_id, duration_ms, CAST(http_status_code AS BIGINT) AS http_status_code
FROM ent""", logs=False, access=True, extra=_ENTRY))
def _app_log_json(spark, d):
    p = AP.parse_json(AP.render_json(_entries(spark, d)))
    return p.select("id", "timestamp", "level", "message", "service", "component", "request_id",
                    F.element_at("fields", "duration_ms").try_cast("bigint").alias("duration_ms"),
                    F.element_at("fields", "http_status_code").try_cast("bigint").alias("http_status_code"))


@register("span_metrics", S.with_views(
    f"""SELECT http_method || ' ' || http_path AS operation, CASE WHEN http_status_code >= 400 THEN 'error' ELSE 'success' END AS status,
 count(*) AS count, {R('avg(duration_ms)')} AS avg_duration_ms, {R('max(duration_ms) * 1.0')} AS max_duration_ms
FROM access GROUP BY 1, 2""", logs=False, access=True))
def _span_metrics(spark, d):
    return AC.span_metrics(AP.parse_json(AP.render_json(_entries(spark, d))))


@register("db_slow_ops", S.with_views(
    f"SELECT id, request_id, {R('duration_ms * 1.0')} AS duration_ms, message FROM ent WHERE duration_ms > 100",
    logs=False, access=True, extra=_ENTRY))
def _db_slow_ops(spark, d):
    return AC.slow_entries(AP.parse_json(AP.render_json(_entries(spark, d))))


@register("merged_fields", S.with_views(
    """SELECT id, '{"duration_ms":"' || CAST(duration_ms AS VARCHAR) || '","http_method":"' || http_method ||
  '","http_path":"redacted","http_remote_addr":"' || http_remote_addr || '","http_status_code":"' ||
  CAST(http_status_code AS VARCHAR) || '","http_user_agent":"' || http_user_agent || '","request_id":"' ||
  request_id || '"}' AS merged_fields FROM ent""", logs=False, access=True, extra=_ENTRY))
def _merged_fields(spark, d):
    """Request fields overridden by context fields (context wins)."""
    p = AP.parse_json(AP.render_json(_entries(spark, d)))
    ctx = F.create_map(F.lit("request_id"), F.col("request_id"), F.lit("http_path"), F.lit("redacted"))
    m = AP.merged_fields(p.withColumn("extra", ctx))
    return m.select("id", F.to_json(F.col("merged_fields")).alias("merged_fields"))


@register("rate_limit_requests", S.with_views(
    """SELECT id, http_remote_addr, window_start, request_number,
 CASE WHEN request_number > 100 THEN 'rejected' WHEN request_number > 50 THEN 'high_rate' ELSE 'ok' END AS decision
FROM (SELECT id, http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) AS window_start,
  row_number() OVER (PARTITION BY http_remote_addr, time_bucket(INTERVAL '1 day', log_ts) ORDER BY log_ts, id) AS request_number
 FROM access)""", logs=False, access=True))
def _rate_limit_requests(spark, d):
    """Per-request rate-limit decision in daily client windows."""
    return AC.rate_limit_requests(load_access(spark, d), "1 day")


@register("request_ids_given", S.with_views(
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'given-' || CAST(id AS VARCHAR) ELSE concat_ws('-', substr(h, 1, 8), substr(h, 9, 4),
 substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) END AS request_id
FROM (SELECT id, sha256('request:' || CAST(id AS VARCHAR)) AS h FROM access)""", logs=False, access=True))
def _request_ids_given(spark, d):
    """A third of the requests bring an id, a third an empty one."""
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit("given-"), F.col("id").cast("string"))).when(F.col("id") % 3 == 1, "")
    return AC.request_ids(load_access(spark, d).withColumn("given", given), "given")


@register("access_sizes", S.with_views(
    f"""SELECT {_SEV} AS severity, count(*) AS requests, {R('avg(duration_ms)')} AS avg_duration_ms,
 CAST(sum(duration_ms % 1000) AS BIGINT) AS total_content_length, {R('avg(duration_ms % 1000)')} AS avg_content_length,
 CAST(sum(CASE WHEN id % 4 > 0 THEN duration_ms * 3 END) AS BIGINT) AS total_response_size,
 {R('avg(CASE WHEN id % 4 > 0 THEN duration_ms * 3 END)')} AS avg_response_size FROM access GROUP BY 1""", logs=False, access=True))
def _access_sizes(spark, d):
    """Outcome classes of requests whose log lines state their sizes, every
    fourth one without a response size."""
    acc = load_access(spark, d).withColumns({
        "content_length": F.col("duration_ms") % 1000, "response_size": F.when(F.col("id") % 4 > 0, F.col("duration_ms") * 3)})
    return AC.access_severity(acc)
