"""Golden totals of the original service's sample data sets."""

import pytest
from pyspark.sql import functions as F
from samples import SAMPLE_5, SAMPLE_12, make_logs

from logspark.config import EngineConfig
from logspark.operators import anomalies as AN
from logspark.operators import errors as E
from logspark.operators import patterns as PT
from logspark.operators import performance as PF
from logspark.operators import reliability as RL
from logspark.operators import security as SC
from logspark.operators import trends as TR
from logspark.plans import report as RP


@pytest.fixture(scope="module")
def s12(spark):
    return make_logs(spark, SAMPLE_12)


def test_error_frequency_12(s12):
    r = E.error_frequency(s12).first()
    assert (r.total_logs, r.total_errors) == (12, 9)
    assert r.error_rate == pytest.approx(75.0)
    assert r.severity_score == pytest.approx(47 / 12)
    lv = {x.level: x["count"] for x in TR.counts_by_level(s12).collect()}
    assert lv == {"error": 6, "fatal": 1, "warn": 2, "info": 3}


def test_reliability_and_summary_12(s12):
    r = RL.reliability_score(s12).first()
    assert r.score == pytest.approx(50.083333, abs=1e-6)
    assert (r.grade, r.volume_factor, r.source_count) == ("F", 20.0, 7)
    s = RL.report_summary(s12).first()
    assert s.health_status == "critical"
    assert s.time_range == "2025-08-29T10:15:30 to 2025-08-29T10:21:00"
    assert (s.most_active_source, s.peak_activity_hour, s.error_rate) == ("api_service", 10, 75.0)


def test_security_12(s12):
    r = SC.security_summary(s12).first()
    assert (r.failed_logins, r.access_violations, r.threats_detected, r.security_score) == (1, 0, 1, 90)
    ev = SC.security_events(s12).filter("event_type = 'injection'").first()
    assert ev.severity == "high"


def test_signatures_and_anomalies_12(s12):
    sig = PT.error_signatures(s12).collect()
    assert [(x.pattern, x["count"]) for x in sig] == [("Database connection failed after NUM retries", 2)]
    assert AN.rule_anomalies(s12).count() == 0


def test_performance_intended_12(s12):
    d = PF.response_time_distribution(s12).first()
    assert (d.average, d.p50, d.p95, d.max) == (4900.0, 5500.0, 8000.0, 8000.0)
    s = PF.performance_summary(s12).first()
    assert (s.performance_score, s.slow_operations) == (51.0, 2)
    b = PF.bottlenecks(s12).collect()
    assert [(x.source, x.slow_operations, x.total_operations, x.severity) for x in b] == [("api_service", 2, 3, "high")]


def test_performance_reference_units_12(s12):
    cfg = EngineConfig(unit_mode="reference")
    s = PF.performance_summary(s12, cfg).first()
    assert (s.performance_score, s.slow_operations) == (0.0, 3)
    b = PF.bottlenecks(s12, cfg).orderBy(F.col("slow_ratio").desc(), "source").collect()
    assert [(x.source, x.slow_operations, x.total_operations) for x in b] == [("backup_service", 1, 1), ("api_service", 2, 3)]


def test_alerts_and_recommendations_12(s12):
    al = RP.alerts(s12).collect()
    assert sorted(a.rule for a in al) == ["error_rate", "security_threats"]
    recs = RP.recommendations(s12).collect()
    assert [r.recommendation for r in recs] == ["High error rate detected (75.0%). Investigate error patterns and implement fixes."]


def test_report_is_one_row(s12):
    r = RP.report(s12).collect()
    assert len(r) == 1
    assert r[0].summary.total_logs_analyzed == 12
    assert r[0].alerts_raised == 2


def test_sample_5(spark):
    s5 = make_logs(spark, SAMPLE_5)
    r = E.error_frequency(s5).first()
    assert (r.total_errors, r.error_rate) == (3, pytest.approx(60.0))
    assert r.severity_score == pytest.approx(2.7)
    lv = {x.level: x["count"] for x in E.errors_by_level(s5).collect()}
    assert lv == {"error": 2, "warn": 1}


def test_empty_input(spark):
    empty = make_logs(spark, []) if False else spark.createDataFrame(
        [], "id bigint, log_ts timestamp_ntz, level string, message string, source string")
    r = E.error_frequency(empty).first()
    assert (r.total_logs, r.total_errors, r.error_rate) == (0, 0, 0.0)
    assert RL.reliability_score(empty).count() == 0
    assert PF.response_time_distribution(empty).count() == 0


def test_malformed_rows(spark):
    df = spark.createDataFrame(
        [(1, "error", "Valid error", None), (2, None, "Missing level", None), (3, "info", None, None),
         (4, "error", "Another valid error", None)],
        "id bigint, level string, message string, source string").withColumn("log_ts", F.lit(None).cast("timestamp_ntz"))
    r = E.error_frequency(df).first()
    assert r.total_errors == 2


def test_render_text_12(s12):
    rows = RP.render_text(s12, verbose=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.section, []).append(r.text)
    assert by["summary"][0] == "Total logs analyzed: 12"
    assert "Health status: critical" in by["summary"]
    assert by["recommendations"] == ["High error rate detected (75.0%). Investigate error patterns and implement fixes."]
    assert "anomalies" not in by                       # the sample has no rule anomalies
    assert sorted(by["levels"]) == ["error: 6", "fatal: 1", "info: 3", "warn: 2"]
