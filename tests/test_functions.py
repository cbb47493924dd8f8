"""Scalar functions on hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from logspark.functions import levels as L
from logspark.functions import text as X


def one(spark, col, value, schema="m string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("msg,expected", [
    ("Request timeout while processing /api/users (took 5500ms)", "Request timeout while processing /PATH (took 5500ms)"),
    ("Failed login attempt for user admin from IP 192.168.1.100", "Failed login attempt for user admin from IP NUM.NUM.NUM.NUM"),
    ("Disk space usage at 85% on server-01", "Disk space usage at NUM% on server-NUM"),
    ("Permission denied for object deadbeef1000", "Permission denied for object ID"),
    ("  padded 7\t", "padded NUM"),
    ("", ""),
])
def test_error_pattern(spark, msg, expected):
    assert one(spark, X.error_pattern("m"), msg) == expected


@pytest.mark.parametrize("msg,expected", [
    ("User authentication successful for user_123", "user authentication successful"),
    ("Disk space usage at 85% on server-01", "disk space usage NUM server"),
    ("The cache for this server and that one", "cache server one"),
])
def test_message_signature(spark, msg, expected):
    assert one(spark, X.message_signature("m"), msg) == expected


def test_cluster_signature(spark):
    assert one(spark, X.cluster_signature("m"), "User authentication successful for user_123") == \
        "authentication successful user"
    assert one(spark, X.cluster_signature("m"), "ok 12 no") == ""


def test_terms_drop_stop_words(spark):
    assert one(spark, X.terms("m"), "The disk is full and the CPU was hot") == ["disk", "full", "cpu", "hot"]


@pytest.mark.parametrize("msg,intended,reference", [
    ("took 1200ms", 1200.0, 1200000.0),
    ("duration: 5.67s", 5670.0, 5670.0),
    ("time=0ms", None, None),
    ("no timing here", None, None),
    ("Cache cleared, DURATION 3s", 3000.0, 3000.0),
])
def test_response_time(spark, msg, intended, reference):
    got_i = one(spark, X.response_time("m", "intended"), msg)
    got_r = one(spark, X.response_time("m", "reference"), msg)
    assert (got_i, got_r) == (pytest.approx(intended) if intended else None,
                              pytest.approx(reference) if reference else None)


@pytest.mark.parametrize("line,level", [
    ("FATAL error in x", "error"),
    ("a WARN here", "warn"),
    ("debug: x", "debug"),
    ("Fatal only in mixed case", "info"),
    ("fatal crash", "fatal"),
    ("plain", "info"),
])
def test_sniff_level(spark, line, level):
    assert one(spark, L.sniff_level(F.col("m")), line) == level


@pytest.mark.parametrize("score,grade", [(95, "A"), (90, "A"), (85, "B"), (70, "C"), (60, "D"), (59.9, "F")])
def test_reliability_grade(spark, score, grade):
    assert one(spark, L.reliability_grade(F.col("m")), float(score), "m double") == grade


@pytest.mark.parametrize("rate,status", [(0.5, "excellent"), (1.0, "good"), (14.9, "warning"), (15.0, "critical")])
def test_health_status(spark, rate, status):
    assert one(spark, L.health_status(F.col("m")), rate, "m double") == status


@pytest.mark.parametrize("name,ordinal,back", [("DEBUG", 0, "DEBUG"), ("WARNING", 2, "WARN"), ("nonsense", 1, "INFO"),
                                               ("FATAL", 4, "FATAL")])
def test_level_parse(spark, name, ordinal, back):
    assert one(spark, L.level_ordinal(F.col("m")), name) == ordinal
    assert one(spark, L.level_name(L.level_ordinal(F.col("m"))), name) == back


@pytest.mark.parametrize("code,sev", [(500, "error"), (404, "warn"), (200, "info"), (399, "info")])
def test_status_severity(spark, code, sev):
    assert one(spark, L.status_severity(F.col("m")), code, "m int") == sev
