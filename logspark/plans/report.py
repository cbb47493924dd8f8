"""Report assembly: recommendations, alerts and the one-row nested report.

Every section derives from the log facts (counts per source, level and
hour; see :mod:`logspark.operators.facts`) plus one aggregate of error
patterns, so a report scans its input twice however many sections it has.
The facts are checkpointed once per report (a few hundred rows); the report
is a cross join of one-row aggregates, so the driver only receives one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..operators import anomalies as AN
from ..operators import facts as FT
from ..operators import reliability as RL
from ..sources.normalize import enrich
from ..sources.scans import ts_lit

# fixed values: recommendation and alert texts of the dashboard
REC_ERROR_RATE = "High error rate detected (%.1f%%). Investigate error patterns and implement fixes."
REC_TOP_SOURCE = "Source '%s' has %d errors. Focus debugging efforts here."
REC_ANOMALY = "High-severity anomaly detected: %s. Immediate investigation recommended."
REC_SLOW = "%d slow operations detected. Consider performance optimization."
REC_DEFAULT = "System appears to be operating normally. Continue monitoring."
ALERT_ERROR_RATE = "High error rate alert: %.1f%% error rate detected"
ALERT_ANOMALIES = "High-severity anomalies detected: %d anomalies found"
ALERT_THREATS = "Security threats detected: %d potential threats found"
ALERT_SLOW = "Performance degradation detected: %d slow operations"


def _e(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    return enrich(df, cfg, ("is_narrow_error", "pattern"))


def _slow_count(f: DataFrame) -> DataFrame:
    return f.agg(F.coalesce(F.sum("slow"), F.lit(0)).alias("slow_ops"))


def _rules(e: DataFrame, cfg: EngineConfig, f: DataFrame, rules: DataFrame | None) -> DataFrame:
    r = rules if rules is not None else AN.rule_anomalies(e, cfg, f)
    return r if cfg.anomaly_detection_enabled else r.limit(0)


def _high_anomalies(e: DataFrame, cfg: EngineConfig, f: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    return _rules(e, cfg, f, rules).filter(F.col("severity") == "high")


def facts_for_report(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Checkpointed log facts shared by every report section."""
    return FT.checkpointed_facts(df, cfg)


def recommendations(df: DataFrame, cfg: EngineConfig = DEFAULT, facts: DataFrame | None = None,
                    rules: DataFrame | None = None) -> DataFrame:
    """``(rank, recommendation)`` rows in the dashboard's order; the default
    line appears only when no rule fires.  The slow-operation rule counts all
    slow operations, not a truncated list."""
    e = _e(df, cfg)
    f = facts if facts is not None else facts_for_report(df, cfg)
    ef = FT.error_frequency_from(f)
    r1 = ef.filter(F.col("error_rate") > 10).select(
        F.lit(1).alias("rank"), F.format_string(REC_ERROR_RATE, F.col("error_rate")).alias("recommendation"))
    top = (FT.errors_by_source_from(f)
           .agg(F.min_by(F.struct("source", "count"), F.struct(-F.col("count"), F.col("source"))).alias("t"))
           .filter(F.col("t.count") > 5))
    r2 = top.select(F.lit(2).alias("rank"),
                    F.format_string(REC_TOP_SOURCE, F.col("t.source"), F.col("t.count")).alias("recommendation"))
    r3 = _high_anomalies(e, cfg, f, rules).select(F.lit(3).alias("rank"),
                                            F.format_string(REC_ANOMALY, F.col("type")).alias("recommendation"))
    r4 = _slow_count(f).filter(F.col("slow_ops") > 5).select(
        F.lit(4).alias("rank"), F.format_string(REC_SLOW, F.col("slow_ops")).alias("recommendation"))
    fired = r1.unionByName(r2).unionByName(r3).unionByName(r4)
    none = fired.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit(5).alias("rank"), F.lit(REC_DEFAULT).alias("recommendation"))
    return fired.unionByName(none)


def alerts(df: DataFrame, cfg: EngineConfig = DEFAULT, alert_ts=None, facts: DataFrame | None = None,
           rules: DataFrame | None = None) -> DataFrame:
    """ALERT rows (alert_ts, rule, message, value, threshold).  ``alert_ts``
    defaults to the newest log time so reruns are reproducible."""
    e = _e(df, cfg)
    f = facts if facts is not None else facts_for_report(df, cfg)
    if alert_ts is None:
        alert_ts = f.agg(F.max("t1")).first()[0]
    ts = ts_lit(alert_ts) if alert_ts is not None else F.lit(None).cast("timestamp_ntz")
    ef = FT.error_frequency_from(f)
    a1 = ef.filter(F.col("error_rate") > cfg.alert_threshold).select(
        F.lit("error_rate").alias("rule"), F.format_string(ALERT_ERROR_RATE, F.col("error_rate")).alias("message"),
        F.col("error_rate").alias("value"), F.lit(float(cfg.alert_threshold)).alias("threshold"))
    a2 = (_high_anomalies(e, cfg, f, rules).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
          .select(F.lit("high_severity_anomalies").alias("rule"), F.format_string(ALERT_ANOMALIES, F.col("n")).alias("message"),
                  F.col("n").cast("double").alias("value"), F.lit(0.0).alias("threshold")))
    a3 = (FT.security_from(f).filter(F.col("threats_detected") > 0)
          .select(F.lit("security_threats").alias("rule"),
                  F.format_string(ALERT_THREATS, F.col("threats_detected")).alias("message"),
                  F.col("threats_detected").cast("double").alias("value"), F.lit(0.0).alias("threshold")))
    a4 = (_slow_count(f).filter(F.col("slow_ops") > 10)
          .select(F.lit("slow_operations").alias("rule"), F.format_string(ALERT_SLOW, F.col("slow_ops")).alias("message"),
                  F.col("slow_ops").cast("double").alias("value"), F.lit(10.0).alias("threshold")))
    out = a1.unionByName(a2).unionByName(a3).unionByName(a4).select(ts.alias("alert_ts"), "*")
    return out if cfg.auto_alert_enabled else out.limit(0)


def report(df: DataFrame, cfg: EngineConfig = DEFAULT, as_of=None) -> DataFrame:
    """The comprehensive analysis as one row of nested structs."""
    e = _e(df, cfg)
    f = facts_for_report(df, cfg)
    if as_of is None:
        as_of = f.agg(F.max("t1")).first()[0]
    summary = RL.report_summary(e, f).select(F.struct("*").alias("summary"))
    errors = FT.error_frequency_from(f).select(F.struct("*").alias("error_analysis"))
    rel = RL.reliability_score(e, f).select(F.struct("*").alias("reliability_score"))
    perf = FT.performance_from(f).select(F.struct("*").alias("performance_analysis"))
    sec = FT.security_from(f).select(F.struct("*").alias("security_analysis"))
    # rule anomalies once per report: at most one row per source plus the
    # flagged error patterns, checkpointed next to the facts
    rules = AN.rule_anomalies(e, cfg, f).checkpoint(eager=True)
    anom = _rules(e, cfg, f, rules).agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.count(F.when(F.col("severity") == "high", 1)).alias("high_severity")).select(
        F.struct("*").alias("anomaly_analysis"))
    recs = recommendations(e, cfg, f, rules).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "recommendation"))), lambda s: s["recommendation"])
        .alias("recommendations"))
    n_alerts = alerts(e, cfg, as_of, f, rules).agg(F.count(F.lit(1)).alias("alerts_raised"))
    return (summary.crossJoin(errors).crossJoin(rel).crossJoin(perf).crossJoin(sec).crossJoin(anom)
            .crossJoin(recs).crossJoin(n_alerts)
            .select(ts_lit(as_of).alias("report_ts"), "*"))


def report_json(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return report(df, cfg).select(F.to_json(F.struct("*")).alias("report"))


def render_text(df: DataFrame, cfg: EngineConfig = DEFAULT, verbose: bool = False) -> DataFrame:
    """The CLI's text view as ``(section, line_no, text)`` rows: summary,
    top-5 rule anomalies, top-3 merged ML anomalies, top-5 recommendations
    and, with ``verbose``, per-level counts.  Every part is a small top-k."""
    from ..operators import ml as ML
    from ..operators import trends as TR
    e = _e(df, cfg)
    f = facts_for_report(df, cfg)
    s = RL.report_summary(e, f)
    summary = s.select(F.explode(F.array(
        F.format_string("Total logs analyzed: %d", F.col("total_logs_analyzed")),
        F.concat(F.lit("Time range: "), F.col("time_range")),
        F.concat(F.lit("Health status: "), F.col("health_status")),
        F.format_string("Error rate: %.2f%% (%d errors)", F.col("error_rate"), F.col("error_count")),
        F.concat(F.lit("Most active source: "), F.col("most_active_source")),
        F.concat(F.lit("Peak activity hour: "), F.coalesce(F.col("peak_activity_hour").cast("string"), F.lit("unknown"))),
    )).alias("text")).select(F.lit("summary").alias("section"), "text")
    sev_rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    anomalies = (_rules(e, cfg, f, None)
                 .orderBy(sev_rank, F.col("type"), F.coalesce("source", "pattern")).limit(5)
                 .select(F.lit("anomalies").alias("section"),
                         F.format_string("[%s] %s: %s", F.upper("severity"), F.col("type"),
                                         F.coalesce("source", "pattern")).alias("text")))
    ml = (ML.merged_anomalies(df, cfg=cfg).orderBy(F.col("confidence").desc(), F.col("type"),
                                                   F.col("description")).limit(3)
          .select(F.lit("ml_anomalies").alias("section"),
                  F.format_string("%s (confidence %.2f): %s", F.col("type"), F.col("confidence"),
                                  F.col("description")).alias("text")))
    recs = (recommendations(e, cfg, f).orderBy("rank", "recommendation").limit(5)
            .select(F.lit("recommendations").alias("section"), F.col("recommendation").alias("text")))
    parts = [summary, anomalies, ml, recs]
    if verbose:
        parts.append(TR.counts_by_level(e).orderBy("level").select(
            F.lit("levels").alias("section"), F.format_string("%s: %d", F.col("level"), F.col("count")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.create_map(*[x for i, sname in enumerate(("summary", "anomalies", "ml_anomalies", "recommendations",
                                                        "levels")) for x in (F.lit(sname), F.lit(i))])
    return out.select("section", "text", F.element_at(order, F.col("section")).alias("section_no"))
