"""Statistical detectors on small fixtures where the data is always empty."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logspark.operators import ml as ML
from logspark.operators.buckets import bucketed


def logs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, log_ts timestamp_ntz, level string, message string, source string")


T0 = dt.datetime(2024, 1, 1)


def test_clustering_score_regular_and_bursty(spark):
    rows = []
    # source a: 6 errors exactly 60 s apart -> cv 0 -> score 1
    rows += [(i, T0 + dt.timedelta(seconds=60 * i), "error", "x", "a") for i in range(6)]
    # source b: 2 logs only -> skipped (< 5 logs)
    rows += [(100 + i, T0 + dt.timedelta(seconds=i), "error", "x", "b") for i in range(2)]
    # source c: one error among 5 logs -> score 0
    rows += [(200 + i, T0 + dt.timedelta(seconds=i), "error" if i == 0 else "info", "x", "c") for i in range(5)]
    # source d: errors spread over hour buckets (gap stitching across buckets): gaps 10, 3590, 10
    ts = [T0, T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=3600), T0 + dt.timedelta(seconds=3610)]
    rows += [(300 + i, t, "fatal", "x", "d") for i, t in enumerate(ts)] + [(310, T0, "info", "x", "d")]
    df = logs(spark, rows)
    s = {r.source: r.clustering_score for r in ML.error_time_clustering(df).collect()}
    assert s["a"] == pytest.approx(1.0) and s["c"] == 0.0 and "b" not in s
    gaps = [10.0, 3590.0, 10.0]
    mean = sum(gaps) / 3
    std = (sum((g - mean) ** 2 for g in gaps) / 3) ** 0.5
    assert s["d"] == pytest.approx(max(0.0, 1 - (std / mean) / 2))
    g = sorted(r.gap_seconds for r in ML.error_gaps(df).filter("source = 'd'").collect() if r.gap_seconds is not None)
    assert g == [10.0, 10.0, 3590.0]
    flagged = ML.clustering_anomalies(df).collect()
    assert [r.source for r in flagged] == ["a"]


def test_rare_pattern_and_volume_drop(spark):
    rows = [(i, T0 + dt.timedelta(minutes=10 * (i % 10)), "info", "common message text here", "s") for i in range(200)]
    rows += [(1000, T0 + dt.timedelta(minutes=200), "info", "totally unusual words", "s")]
    df = logs(spark, rows)
    # two signatures: their population z-scores are always +1 and -1, so nothing is flagged
    assert ML.pattern_anomalies(df).count() == 0
    # 12 windows: 11 with 20 logs, 1 with a single log -> a drop
    rows = [(i, T0 + dt.timedelta(minutes=10 * (i % 11)), "info", "m", "s") for i in range(220)]
    rows += [(999, T0 + dt.timedelta(minutes=500), "info", "m", "s")]
    vol = ML.temporal_volume_anomalies(logs(spark, rows)).collect()
    assert [r.type for r in vol] == ["temporal_volume_drop"]
    assert vol[0].severity == "high"


def test_rare_pattern_fixture(spark):
    # 30 signatures seen 50 times each and one seen once: z of the single one < -2
    rows = []
    k = 0
    for s in range(30):
        for _ in range(50):
            rows.append((k, T0, "info", f"word{chr(97 + s % 26)}{chr(97 + s // 26)} alpha", "s"))
            k += 1
    rows.append((k, T0, "info", "lonely message", "s"))
    pa = ML.pattern_anomalies(logs(spark, rows)).collect()
    rare = [r for r in pa if r.type == "rare_pattern_anomaly"]
    assert len(rare) == 1 and rare[0].pattern == "lonely message" and rare[0].confidence == 0.6


def test_merge_equivalence_classes(spark):
    cols = [c for c, _ in ML.ANOMALY_COLUMNS]
    types = dict(ML.ANOMALY_COLUMNS)
    data = [
        ("clustering", 5, "error_time_clustering", "a", None, None, None, 3, 0.8, None, None, 0.8, "high", "d1"),
        ("clustering", 5, "error_time_clustering", "a", None, None, None, 4, 0.9, None, None, 0.9, "high", "d2"),
        ("clustering", 5, "error_time_clustering", "b", None, None, None, 1, 0.75, None, None, 0.75, "high", "d3"),
        ("pattern", 2, "frequent_pattern_anomaly", None, "p", None, None, 10, None, 2.0, 2.5, 0.83, "medium", "d4"),
        ("pattern", 2, "frequent_pattern_anomaly", None, "p", None, None, 5, None, 2.0, 2.2, 0.7, "medium", "d5"),
        ("temporal", 3, "temporal_volume_spike", None, None, None, T0, None, 9.0, 2.0, 3.0, 1.0, "medium", "d6"),
        ("temporal", 3, "temporal_volume_spike", None, None, None, T0 + dt.timedelta(minutes=10), None, 8.0, 2.0,
         2.5, 0.83, "medium", "d7"),
    ]
    schema = ", ".join(f"{c} {types[c]}" for c in cols)
    m = ML.merge_similar(spark.createDataFrame(data, schema)).collect()
    by = {(r.type, r.source, r.pattern, r.window_start): r for r in m}
    a = by[("error_time_clustering", "a", None, None)]
    assert (a["count"], a.confidence, a.merged_count) == (7, 0.9, 2)
    assert a.description == "d2 (merged from 2 similar anomalies)"
    p = by[("frequent_pattern_anomaly", None, "p", None)]
    assert (p["count"], p.confidence, p.merged_count, p.description) == (15, 0.83, 2, "d4 (merged from 2 similar anomalies)")
    assert by[("error_time_clustering", "b", None, None)].merged_count is None
    assert len(m) == 5          # the two temporal spikes have neither source nor pattern: never merged


def test_features_invariants(spark):
    df = logs(spark, [(i, T0 + dt.timedelta(minutes=i), ["info", "error", "debug"][i % 3], f"msg {i % 4}", "s")
                      for i in range(40)])
    f = ML.ml_features(df).first()
    assert f.total_volume == 40 and f.source_diversity == pytest.approx(1 / 40)
    ratios = f.level_debug_ratio + f.level_info_ratio + f.level_warn_ratio + f.level_error_ratio + f.level_fatal_ratio
    assert ratios == pytest.approx(1.0)
    n_sig = df.select(F.countDistinct(F.expr("message"))).first()[0]
    import math
    assert 0 <= f.message_entropy <= math.log2(max(n_sig, 1)) + 1e-9


def test_error_gaps_hot_source_is_split_and_exact(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(3000):                     # 90 % of all errors come from one source
        src = "hot" if i % 10 else f"cold{i % 3}"
        rows.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 20000)), "error", "x", src))
    df = logs(spark, rows)
    got = {r.id: r.gap_seconds for r in ML.error_gaps(df, rows_per_bucket=100).collect()}
    # brute force: sort each source by (ts, id) and diff neighbours
    by_src = {}
    for r in rows:
        by_src.setdefault(r[4], []).append((r[1], r[0]))
    want = {}
    for src, items in by_src.items():
        items.sort()
        want[items[0][1]] = None
        for (t_prev, _), (t, i) in zip(items, items[1:]):
            want[i] = (t - t_prev).total_seconds()
    assert got == want
    # the hot source is cut into many pieces, none much larger than asked for
    e = ML._e(df).filter("is_narrow_error").select("source", "id", "log_ts")
    pieces = [r["count"] for r in bucketed(e, ["source"], "log_ts", 100).filter("source = 'hot'")
              .groupBy("_bucket").count().collect()]
    assert len(pieces) >= 20 and max(pieces) <= 200


def test_statistical_anomaly_fires_on_error_burst(spark):
    # 8 quiet days (5 % errors, hourly spread) then a last day with 80 % errors
    rows, k = [], 0
    for day in range(9):
        for i in range(200):
            ts = T0 + dt.timedelta(days=day, minutes=7 * i)
            bad = (i % 20 == 0) if day < 8 else (i % 5 != 0)
            rows.append((k, ts, "error" if bad else "info", f"msg {i % 7}", f"s{i % 3}"))
            k += 1
    df = logs(spark, rows)
    base = {r.feature: r for r in ML.baseline_features(df, 7).collect()}
    # [as_of - 8 days, as_of - 1 day] is not day-aligned: 7 full days plus a partial first day
    assert base["error_rate"].n_days == 8 and base["error_rate"].mean < 0.06
    an = {r.feature: r for r in ML.statistical_anomalies(df, 7).collect()}
    assert "error_rate" in an
    e = an["error_rate"]
    assert e.severity == "high" and e.confidence == 1.0 and e.value > 0.5
    assert e.description.startswith("Statistical anomaly in error_rate: ")
    merged = ML.merged_anomalies(df, 7).filter("type = 'statistical_anomaly'").collect()
    assert {r.feature for r in merged} == set(an)
