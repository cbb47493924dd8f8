"""The report's facts-based sections equal the standalone row-based queries."""

import json
import os
import uuid

import pytest

from logspark.config import checkpoint_dir
from logspark.operators import errors as E
from logspark.operators import performance as PF
from logspark.operators import security as SC
from logspark.plans import report as RP
from logspark.sinks.writers import append_alerts, export_report_json
from logspark.sources.tables import load_logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return load_logs(spark, SF)


@pytest.fixture(scope="module")
def rep(logs):
    return RP.report(logs).first()


def _approx(a: dict, b: dict):
    assert a.keys() == b.keys()
    for k in a:
        if isinstance(a[k], float) or isinstance(b[k], float):
            assert a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-12), k
        else:
            assert a[k] == b[k], k


def test_error_section(logs, rep):
    _approx(rep.error_analysis.asDict(), E.error_frequency(logs).first().asDict())


def test_security_section(logs, rep):
    _approx(rep.security_analysis.asDict(), SC.security_summary(logs).first().asDict())


def test_performance_section(logs, rep):
    _approx(rep.performance_analysis.asDict(), PF.performance_summary(logs).first().asDict())


def test_recommendations_and_alerts_in_report(logs, rep):
    recs = [r.recommendation for r in RP.recommendations(logs).orderBy("rank", "recommendation").collect()]
    assert sorted(rep.recommendations) == sorted(recs)
    assert rep.alerts_raised == RP.alerts(logs).count()


def test_report_and_alert_sinks(spark, logs):
    base = os.path.join(checkpoint_dir(spark), "t", uuid.uuid4().hex)
    export_report_json(RP.report(logs), f"{base}/report")
    files = [f for f in os.listdir(f"{base}/report") if f.endswith(".json")]
    doc = json.loads(open(os.path.join(f"{base}/report", files[0])).read())
    assert doc["summary"]["total_logs_analyzed"] == logs.count()
    for _ in range(2):
        append_alerts(RP.alerts(logs), f"{base}/alerts")
    assert spark.read.parquet(f"{base}/alerts").count() == 2 * RP.alerts(logs).count()
