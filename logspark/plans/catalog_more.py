"""Registered queries: patterns, anomalies, performance, security, ML."""

from __future__ import annotations

from ..config import EngineConfig
from ..operators import anomalies as AN
from ..operators import ml as ML
from ..operators import patterns as PT
from ..operators import performance as PF
from ..operators import reliability as RL
from ..operators import security as SC
from . import sqlbits as S
from .catalog import MAX_TS, R, _elogs, _logs, register
from .oracle_values import SECURITY_RULES

# ------------------------------------------------------------- patterns -----


@register("frequent_terms", S.with_views(
    f"""SELECT term, count(*) AS count FROM (SELECT unnest({S.terms()}) AS term FROM logs)
GROUP BY term ORDER BY count DESC, term LIMIT 20"""))
def _frequent_terms(spark, d):
    return PT.frequent_terms(_logs(spark, d), 20)


@register("error_signatures", S.with_views(
    """SELECT pattern, count(*) AS count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
 min(log_ts) AS first_seen, max(log_ts) AS last_seen
FROM elogs WHERE is_narrow_error AND pattern <> '' GROUP BY pattern HAVING count(*) > 1""", enriched=True))
def _error_signatures(spark, d):
    return PT.error_signatures(_logs(spark, d))


@register("error_signature_sources", S.with_views(
    """SELECT pattern, source, count(*) AS count FROM elogs WHERE is_narrow_error AND pattern <> ''
 AND pattern IN (SELECT pattern FROM elogs WHERE is_narrow_error GROUP BY pattern HAVING count(*) > 1)
GROUP BY pattern, source""", enriched=True))
def _error_signature_sources(spark, d):
    return PT.error_signature_sources(_logs(spark, d))


@register("message_signature_counts", S.with_views(
    "SELECT signature, count(*) AS count FROM elogs GROUP BY signature", enriched=True))
def _message_signature_counts(spark, d):
    return PT.message_signature_counts(_logs(spark, d))


@register("message_clusters", S.with_views(
    "SELECT cluster, count(*) AS count FROM elogs GROUP BY cluster HAVING count(*) > 1 ORDER BY count DESC, cluster LIMIT 10",
    enriched=True))
def _message_clusters(spark, d):
    return PT.message_clusters(_logs(spark, d), 10)


@register("cluster_samples", S.with_views(
    """SELECT cluster, sample_rank, id, message FROM (
 SELECT cluster, id, message, row_number() OVER (PARTITION BY cluster ORDER BY id) AS sample_rank
 FROM elogs WHERE cluster IN (SELECT cluster FROM elogs GROUP BY cluster HAVING count(*) > 1
                              ORDER BY count(*) DESC, cluster LIMIT 10))
WHERE sample_rank <= 3""", enriched=True))
def _cluster_samples(spark, d):
    return PT.cluster_samples(_logs(spark, d), 10, 3)


# ----------------------------------------------------- rule anomalies -------
@register("high_error_rate_sources", S.with_views(
    f"""SELECT source, total_logs, error_count, {R("error_rate")} AS error_rate,
 CASE WHEN error_rate > 50 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT source, count(*) AS total_logs, count(*) FILTER (WHERE {S.NARROW}) AS error_count,
  count(*) FILTER (WHERE {S.NARROW}) * 100.0 / count(*) AS error_rate FROM logs GROUP BY source)
WHERE error_rate > 20 AND total_logs > 5"""))
def _high_error_rate_sources(spark, d):
    return AN.high_error_rate_sources(_logs(spark, d))


_PC = "pc AS (SELECT pattern, count(*) AS count FROM elogs WHERE is_narrow_error AND pattern <> '' GROUP BY pattern)"


@register("frequent_error_patterns", S.with_views(
    f"""SELECT pattern, count, {R("threshold")} AS threshold,
 CASE WHEN count > threshold * 2 THEN 'high' ELSE 'medium' END AS severity
FROM pc, (SELECT count(*) AS n_patterns, avg(count) + 2.0 * stddev_samp(count) AS threshold FROM pc) st
WHERE n_patterns > 1 AND count > threshold AND count > 3""", enriched=True, extra=_PC))
def _frequent_error_patterns(spark, d):
    return AN.frequent_error_patterns(_logs(spark, d))


# ---------------------------------------------------------- performance -----
def _rt_rel(mode="intended"):
    return f"(SELECT *, {S.response_time('message', mode)} AS rt FROM logs)"


@register("response_times", S.with_views(
    f"SELECT id, log_ts, source, message, {R('rt')} AS response_time FROM {_rt_rel()} WHERE rt IS NOT NULL"))
def _response_times(spark, d):
    return PF.response_times(_logs(spark, d))


@register("response_times_reference", S.with_views(
    f"SELECT id, log_ts, source, message, {R('rt')} AS response_time FROM {_rt_rel('reference')} WHERE rt IS NOT NULL"))
def _response_times_reference(spark, d):
    return PF.response_times(_logs(spark, d), EngineConfig(unit_mode="reference"))


_RT_RANKED = f"""rt AS (SELECT rt AS v, row_number() OVER (ORDER BY rt) - 1 AS k, count(*) OVER () AS n
 FROM {_rt_rel()} WHERE rt IS NOT NULL)"""


@register("response_time_distribution", S.with_views(
    f"""SELECT {R("avg(v)")} AS average, {R("min(v)")} AS min, {R("max(v)")} AS max,
 {R("max(v) FILTER (WHERE k = n // 2)")} AS p50,
 {R("max(v) FILTER (WHERE k = LEAST(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1))")} AS p95,
 {R("max(v) FILTER (WHERE k = LEAST(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1))")} AS p99
FROM rt HAVING count(*) > 0""", extra=_RT_RANKED))
def _response_time_distribution(spark, d):
    return PF.response_time_distribution(_logs(spark, d))


@register("slow_operations", S.with_views(
    f"""SELECT id, log_ts, source, {R('rt')} AS response_time, substr(message, 1, 100) AS message
FROM {_rt_rel()} WHERE rt > 5000 ORDER BY rt DESC, id LIMIT 10"""))
def _slow_operations(spark, d):
    return PF.slow_operations(_logs(spark, d))


@register("bottlenecks", S.with_views(
    f"""SELECT source, slow_operations, total_operations, {R("slow_ratio")} AS slow_ratio,
 CASE WHEN slow_ratio > 0.3 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT source, count(*) FILTER (WHERE rt > 5000) AS slow_operations, count(*) AS total_operations,
  count(*) FILTER (WHERE rt > 5000) * 1.0 / count(*) AS slow_ratio FROM {_rt_rel()} GROUP BY source)
WHERE slow_operations > 0 AND slow_ratio > 0.1"""))
def _bottlenecks(spark, d):
    return PF.bottlenecks(_logs(spark, d))


@register("performance_summary", S.with_views(
    f"""SELECT count(rt) AS timed_operations, {R("avg(rt)")} AS average_response_time,
 count(*) FILTER (WHERE rt > 5000) AS slow_operations, count(*) AS total_operations,
 {R("COALESCE(GREATEST(0.0, 100.0 - avg(rt) / 100.0), 0.0)")} AS performance_score FROM {_rt_rel()}"""))
def _performance_summary(spark, d):
    return PF.performance_summary(_logs(spark, d))


# ------------------------------------------------------------- security -----
_RULES_VALUES = ", ".join(f"({S.q(t)}, {S.q(p)})" for t, ps in SECURITY_RULES.items() for p in ps)
_SEC_HITS = f"""hits AS (SELECT DISTINCT l.id, l.log_ts, l.source, l.level, l.message, r.event_type
 FROM logs l JOIN (VALUES {_RULES_VALUES}) r(event_type, phrase) ON contains(lower(l.message), r.phrase))"""


@register("security_events", S.with_views(
    """SELECT id, log_ts, source, event_type,
 CASE WHEN event_type IN ('suspicious', 'injection') THEN
   CASE WHEN level IN ('error', 'fatal') THEN 'high' ELSE 'medium' END END AS severity,
 substr(message, 1, 100) AS message FROM hits""", extra=_SEC_HITS))
def _security_events(spark, d):
    return SC.security_events(_logs(spark, d))


@register("security_event_counts", S.with_views(
    "SELECT event_type, count(*) AS count FROM hits GROUP BY event_type", extra=_SEC_HITS))
def _security_event_counts(spark, d):
    return SC.security_event_counts(_logs(spark, d))


@register("security_summary", S.with_views(
    """SELECT count(*) FILTER (WHERE event_type = 'failed_login') AS failed_logins,
 count(*) FILTER (WHERE event_type = 'access_violation') AS access_violations,
 count(*) FILTER (WHERE event_type IN ('suspicious', 'injection')) AS threats_detected,
 count(*) AS total_security_events, CAST(GREATEST(0, 100 - 5 * count(*)) AS BIGINT) AS security_score
FROM hits""", extra=_SEC_HITS))
def _security_summary(spark, d):
    return SC.security_summary(_logs(spark, d))


# ------------------------------------------------- reliability / summary ----
_REL_BASE = f"""ef AS (SELECT count(*) AS total_logs, count(*) FILTER (WHERE {S.BROAD}) AS total_errors,
  avg(CASE WHEN {S.BROAD} THEN 100.0 ELSE 0.0 END) AS error_rate, avg({S.severity_weight()}) AS severity_score,
  count(DISTINCT source) AS source_count FROM logs),
hs AS (SELECT avg(c) AS volume_mean, COALESCE(stddev_samp(c), 0.0) AS volume_std
  FROM (SELECT hour(log_ts) AS h, count(*) AS c FROM logs GROUP BY 1))"""


@register("reliability_score", S.with_views(
    f"""SELECT {R("error_rate")} AS error_rate, {R("severity_score")} AS severity_score, {R("volume_std")} AS volume_std,
 source_count, {R("f1")} AS error_rate_factor, {R("f2")} AS severity_factor, {R("f3")} AS volume_factor,
 {R("f4")} AS source_factor, {R("f1 + f2 + f3 + f4")} AS score,
 CASE WHEN f1 + f2 + f3 + f4 >= 90 THEN 'A' WHEN f1 + f2 + f3 + f4 >= 80 THEN 'B'
      WHEN f1 + f2 + f3 + f4 >= 70 THEN 'C' WHEN f1 + f2 + f3 + f4 >= 60 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT *, GREATEST(0.0, 40.0 - error_rate * 2) AS f1, GREATEST(0.0, 20.0 - severity_score) AS f2,
  CASE WHEN volume_std > 0 THEN GREATEST(0.0, 20.0 - volume_std / volume_mean * 10) ELSE 20.0 END AS f3,
  LEAST(20.0, source_count * 2.0) AS f4 FROM ef, hs WHERE total_logs > 0)""", extra=_REL_BASE))
def _reliability_score(spark, d):
    return RL.reliability_score(_logs(spark, d))


@register("report_summary", S.with_views(
    f"""SELECT total_logs AS total_logs_analyzed,
 COALESCE(strftime(t0, '%Y-%m-%dT%H:%M:%S') || ' to ' || strftime(t1, '%Y-%m-%dT%H:%M:%S'), 'Unknown') AS time_range,
 CASE WHEN error_rate < 1 THEN 'excellent' WHEN error_rate < 5 THEN 'good' WHEN error_rate < 15 THEN 'warning'
      ELSE 'critical' END AS health_status,
 total_errors AS error_count, {R("round(error_rate, 2)")} AS error_rate,
 (SELECT source FROM logs GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS most_active_source,
 (SELECT CAST(hour(log_ts) AS BIGINT) FROM logs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_activity_hour
FROM ef, (SELECT min(log_ts) AS t0, max(log_ts) AS t1 FROM logs) WHERE total_logs > 0""", extra=_REL_BASE))
def _report_summary(spark, d):
    return RL.report_summary(_logs(spark, d))


# ------------------------------------------------------------------- ML -----
def features_sql(rel: str, key: str | None = None) -> str:
    """SELECT producing the eleven features of ``rel`` (grouped by ``key``)."""
    k = f"{key}, " if key else ""
    gb = f"GROUP BY {key}" if key else ""
    part = f"PARTITION BY {key}" if key else ""
    levels = ", ".join(f"count(*) FILTER (WHERE level = '{x}') AS n_{x}" for x in ("debug", "info", "warn", "error", "fatal"))
    base = f"""SELECT {k}count(*) AS n, count(*) FILTER (WHERE is_narrow_error) AS n_err,
   count(DISTINCT source) AS n_src, {levels} FROM {rel} {gb}"""
    ent = f"""SELECT {k}-sum((c / t) * log2(c / t)) AS message_entropy FROM (
   SELECT {k}signature, count(*) * 1.0 AS c, sum(count(*)) OVER ({part}) * 1.0 AS t FROM {rel} GROUP BY {k}signature) {gb}"""

    def var(fmt, name):
        return f"""SELECT {k}CASE WHEN count(*) > 1 THEN var_pop(c) ELSE 0.0 END AS {name} FROM (
   SELECT {k}strftime(log_ts, '{fmt}') AS b, count(*) AS c FROM {rel} WHERE log_ts IS NOT NULL GROUP BY {k}b) {gb}"""
    if key:
        frm = f"({base}) b LEFT JOIN ({ent}) e USING ({key}) LEFT JOIN ({var('%H', 'tv')}) h USING ({key}) LEFT JOIN ({var('%H:%M', 'vv')}) m USING ({key})"
    else:
        frm = f"({base}) b, ({ent}) e, ({var('%H', 'tv')}) h, ({var('%H:%M', 'vv')}) m"
    ratios = ", ".join(f"n_{x} * 1.0 / n AS level_{x}_ratio" for x in ("debug", "info", "warn", "error", "fatal"))
    return f"""SELECT {k}n_err * 1.0 / n AS error_rate, GREATEST(COALESCE(message_entropy, 0.0), 0.0) AS message_entropy,
  CASE WHEN n < 2 THEN 0.0 ELSE COALESCE(tv, 0.0) END AS temporal_variance, n_src * 1.0 / n AS source_diversity,
  CAST(n AS DOUBLE) AS total_volume, COALESCE(vv, 0.0) AS volume_variance, {ratios}
 FROM {frm} WHERE n > 0"""


_FEATS = ML.FEATURES


def _rounded_select(cols) -> str:
    return ", ".join(f"{R(c)} AS {c}" for c in cols)


@register("ml_features", S.with_views(
    f"SELECT {_rounded_select(_FEATS)} FROM ({features_sql('elogs')})", enriched=True))
def _ml_features(spark, d):
    return ML.ml_features(_logs(spark, d))


for _f in ("message_entropy", "temporal_variance", "volume_variance"):
    def _mk(f):
        @register(f, S.with_views(f"SELECT {R(f)} AS {f} FROM ({features_sql('elogs')})", enriched=True))
        def _q(spark, d):
            return getattr(ML, f)(_logs(spark, d))
        return _q
    _mk(_f)

_HIST = f"hist AS (SELECT *, CAST(log_ts AS DATE) AS day FROM elogs WHERE log_ts BETWEEN {MAX_TS} - INTERVAL 8 DAY AND {MAX_TS} - INTERVAL 1 DAY)"
_BASE = f"""base AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_days
 FROM (UNPIVOT ({features_sql('hist', 'day')}) ON {', '.join(_FEATS)} INTO NAME feature VALUE value) GROUP BY feature)"""


@register("baseline_features", S.with_views(
    f"SELECT feature, {R('mean')} AS mean, {R('std')} AS std, n_days FROM base", enriched=True,
    extra=_HIST + ",\n" + _BASE))
def _baseline_features(spark, d):
    return ML.baseline_features(_logs(spark, d), 7)


_CUR = f"cur AS (SELECT * FROM elogs WHERE log_ts > {MAX_TS} - INTERVAL 1 DAY AND log_ts <= {MAX_TS})"
_STAT = f"""stat AS (SELECT feature, value, mean AS expected,
  CASE WHEN std = 0 THEN 0.0 ELSE (value - mean) / std END AS z_score
 FROM (UNPIVOT ({features_sql('cur')}) ON {', '.join(_FEATS)} INTO NAME feature VALUE value) JOIN base USING (feature)),
stat_a AS (SELECT feature, value, expected, z_score, LEAST(abs(z_score) / 3.0, 1.0) AS confidence,
  CASE WHEN abs(z_score) > 3 THEN 'high' ELSE 'medium' END AS severity,
  printf('Statistical anomaly in %s: %.3f (expected: %.3f)', feature, value, expected) AS description
 FROM stat WHERE abs(z_score) > 2.5)"""
_STAT_CTES = ",\n".join([_HIST, _BASE, _CUR, _STAT])


@register("statistical_anomalies", S.with_views(
    f"SELECT feature, {R('value')} AS value, {R('expected')} AS expected, {R('z_score')} AS z_score, "
    f"{R('confidence')} AS confidence, severity, description FROM stat_a", enriched=True, extra=_STAT_CTES))
def _statistical_anomalies(spark, d):
    return ML.statistical_anomalies(_logs(spark, d), 7)


_PAT = """pc2 AS (SELECT signature AS pattern, count(*) AS count FROM elogs GROUP BY 1),
pz AS (SELECT pattern, count, mean, (count - mean) / std AS z_score
 FROM pc2, (SELECT avg(count) AS mean, stddev_pop(count) AS std FROM pc2) WHERE std > 0),
pat_a AS (
 SELECT 'frequent_pattern_anomaly' AS type, pattern, count, mean AS expected, z_score,
  LEAST(z_score / 3.0, 1.0) AS confidence, 'medium' AS severity,
  printf('Unusually frequent pattern: ''%s'' appeared %d times', pattern, count) AS description
 FROM pz WHERE z_score > 2
 UNION ALL
 SELECT 'rare_pattern_anomaly', pattern, count, NULL, z_score, 0.6, 'low',
  printf('Rare pattern detected: ''%s''', pattern) FROM pz WHERE z_score < -2 AND count = 1)"""


@register("pattern_anomalies", S.with_views(
    f"SELECT type, pattern, count, {R('expected')} AS expected, {R('z_score')} AS z_score, "
    f"{R('confidence')} AS confidence, severity, description FROM pat_a", enriched=True, extra=_PAT))
def _pattern_anomalies(spark, d):
    return ML.pattern_anomalies(_logs(spark, d))


_WIN = """win AS (SELECT time_bucket(INTERVAL '10 minutes', log_ts) AS window_start, count(*) AS volume,
  count(*) FILTER (WHERE is_narrow_error) AS error_count,
  count(*) FILTER (WHERE is_narrow_error) * 1.0 / count(*) AS error_rate FROM elogs WHERE log_ts IS NOT NULL GROUP BY 1),
vz AS (SELECT window_start, volume, mean, (volume - mean) / std AS z_score
 FROM win, (SELECT count(*) AS n_groups, avg(volume) AS mean, stddev_pop(volume) AS std FROM win)
 WHERE n_groups >= 3 AND std > 0),
vol_a AS (SELECT 'temporal_' || kind AS type, window_start, volume, mean AS expected, z_score,
  LEAST(abs(z_score) / 3.0, 1.0) AS confidence, CASE WHEN abs(z_score) > 3 THEN 'high' ELSE 'medium' END AS severity,
  printf('Temporal %s: %d logs in window (expected: %.1f)', kind, volume, mean) AS description
 FROM (SELECT *, CASE WHEN z_score > 0 THEN 'volume_spike' ELSE 'volume_drop' END AS kind FROM vz WHERE abs(z_score) > 2)),
ez AS (SELECT window_start, error_rate, mean, (error_rate - mean) / std AS z_score
 FROM win, (SELECT count(*) AS n_groups, avg(error_rate) AS mean, stddev_pop(error_rate) AS std FROM win)
 WHERE n_groups >= 3 AND std > 0),
err_a AS (SELECT 'temporal_error_spike' AS type, window_start, error_rate, mean AS expected, z_score,
  LEAST(z_score / 3.0, 1.0) AS confidence, 'high' AS severity,
  printf('Error rate spike: %.1f%% in window (expected: %.1f%%)', error_rate * 100, mean * 100) AS description
 FROM ez WHERE z_score > 2)"""


@register("volume_by_window", S.with_views(
    f"SELECT window_start, volume, error_count, {R('error_rate')} AS error_rate FROM win", enriched=True, extra=_WIN))
def _volume_by_window(spark, d):
    return ML.volume_by_window(_logs(spark, d))


@register("temporal_volume_anomalies", S.with_views(
    f"SELECT type, window_start, volume, {R('expected')} AS expected, {R('z_score')} AS z_score, "
    f"{R('confidence')} AS confidence, severity, description FROM vol_a", enriched=True, extra=_WIN))
def _temporal_volume_anomalies(spark, d):
    return ML.temporal_volume_anomalies(_logs(spark, d))


@register("temporal_error_spikes", S.with_views(
    f"SELECT type, window_start, {R('error_rate')} AS error_rate, {R('expected')} AS expected, {R('z_score')} AS z_score, "
    f"{R('confidence')} AS confidence, severity, description FROM err_a", enriched=True, extra=_WIN))
def _temporal_error_spikes(spark, d):
    return ML.temporal_error_spikes(_logs(spark, d))


_GAPS = """gaps AS (SELECT source, id, log_ts,
  date_diff('microsecond', lag(log_ts) OVER (PARTITION BY source ORDER BY log_ts, id), log_ts) / 1e6 AS gap_seconds
 FROM elogs WHERE is_narrow_error AND log_ts IS NOT NULL),
clus AS (SELECT ps.source, total_logs, error_count,
  CASE WHEN error_count < 2 THEN 0.0 WHEN mean_gap = 0 THEN 1.0
       ELSE GREATEST(0.0, 1.0 - (std_gap / mean_gap) / 2.0) END AS clustering_score
 FROM (SELECT source, count(*) AS total_logs, count(*) FILTER (WHERE is_narrow_error) AS error_count
       FROM elogs GROUP BY source) ps
 LEFT JOIN (SELECT source, avg(gap_seconds) AS mean_gap, stddev_pop(gap_seconds) AS std_gap
            FROM gaps WHERE gap_seconds IS NOT NULL GROUP BY source) g USING (source)
 WHERE total_logs >= 5 AND error_count > 0),
clus_a AS (SELECT 'error_time_clustering' AS type, source, error_count AS count, clustering_score AS value,
  clustering_score AS confidence, 'high' AS severity,
  printf('Error clustering detected in %s: %d errors clustered in time', source, error_count) AS description
 FROM clus WHERE clustering_score > 0.7)"""


@register("error_gaps", S.with_views(
    f"SELECT source, id, log_ts, {R('gap_seconds')} AS gap_seconds FROM gaps", enriched=True, extra=_GAPS))
def _error_gaps(spark, d):
    return ML.error_gaps(_logs(spark, d))


@register("error_time_clustering", S.with_views(
    f"SELECT source, total_logs, error_count, {R('clustering_score')} AS clustering_score FROM clus",
    enriched=True, extra=_GAPS))
def _error_time_clustering(spark, d):
    return ML.error_time_clustering(_logs(spark, d))


@register("error_time_clustering_flagged", S.with_views(
    f"SELECT type, source, count, {R('value')} AS value, {R('confidence')} AS confidence, severity, description FROM clus_a",
    enriched=True, extra=_GAPS))
def _error_time_clustering_flagged(spark, d):
    return ML.clustering_anomalies(_logs(spark, d))


_WIDE = """wide AS (
 SELECT 'statistical' AS detector, 1 AS ordinal, 'statistical_anomaly' AS type, NULL AS source, NULL AS pattern, feature,
  CAST(NULL AS TIMESTAMP) AS window_start, CAST(NULL AS BIGINT) AS count, value, expected, z_score, confidence, severity, description FROM stat_a
 UNION ALL SELECT 'pattern', 2, type, NULL, pattern, NULL, NULL, count, NULL, expected, z_score, confidence, severity, description FROM pat_a
 UNION ALL SELECT 'temporal', 3, type, NULL, NULL, NULL, window_start, NULL, volume, expected, z_score, confidence, severity, description FROM vol_a
 UNION ALL SELECT 'temporal', 4, type, NULL, NULL, NULL, window_start, NULL, error_rate, expected, z_score, confidence, severity, description FROM err_a
 UNION ALL SELECT 'clustering', 5, type, source, NULL, NULL, NULL, count, value, NULL, NULL, confidence, severity, description FROM clus_a)"""
_ML_CTES = ",\n".join([_STAT_CTES, _PAT, _WIN, _GAPS, _WIDE])
_WIDE_COLS = (f"detector, CAST(ordinal AS INTEGER) AS ordinal, type, source, pattern, feature, window_start, count, "
              f"{R('value')} AS value, {R('expected')} AS expected, {R('z_score')} AS z_score, "
              f"{R('confidence')} AS confidence, severity, description")


@register("ml_anomalies", S.with_views(f"SELECT {_WIDE_COLS} FROM wide", enriched=True, extra=_ML_CTES))
def _ml_anomalies(spark, d):
    return ML.ml_anomalies(_logs(spark, d), 7)


_MERGED = """keyed AS (SELECT *, CASE WHEN source IS NOT NULL AND source <> '' THEN 's:' || source
   WHEN pattern IS NOT NULL AND pattern <> '' THEN 'p:' || pattern
   ELSE 'u:' || detector || '|' || CAST(ordinal AS VARCHAR) || '|' || COALESCE(feature, '') || '|' ||
        COALESCE(CAST(window_start AS VARCHAR), '') || '|' || COALESCE(pattern, '') END AS merge_key FROM wide),
grp AS (SELECT *, row_number() OVER (PARTITION BY type, merge_key ORDER BY confidence DESC, ordinal) AS rk,
  count(*) OVER (PARTITION BY type, merge_key) AS n,
  sum(COALESCE(count, 1)) OVER (PARTITION BY type, merge_key) AS sum_count,
  max(confidence) OVER (PARTITION BY type, merge_key) AS max_conf FROM keyed),
merged AS (SELECT detector, ordinal, type, source, pattern, feature, window_start,
  CAST(CASE WHEN n > 1 AND count IS NOT NULL THEN sum_count ELSE count END AS BIGINT) AS count,
  value, expected, z_score, max_conf AS confidence, severity,
  CASE WHEN n > 1 THEN description || ' (merged from ' || CAST(n AS VARCHAR) || ' similar anomalies)' ELSE description END AS description,
  CAST(CASE WHEN n > 1 THEN n END AS BIGINT) AS merged_count FROM grp WHERE rk = 1)"""


@register("merged_anomalies", S.with_views(
    f"SELECT {_WIDE_COLS}, merged_count FROM merged", enriched=True, extra=_ML_CTES + ",\n" + _MERGED))
def _merged_anomalies(spark, d):
    return ML.merged_anomalies(_logs(spark, d), 7)


@register("ml_anomalies_confident", S.with_views(
    f"SELECT {_WIDE_COLS}, merged_count FROM merged WHERE confidence >= 0.7", enriched=True,
    extra=_ML_CTES + ",\n" + _MERGED))
def _ml_anomalies_confident(spark, d):
    return ML.ml_anomalies_confident(_logs(spark, d), 7)


_ = _elogs  # re-exported helper
