"""Order statistics and pieces of hot groups under skewed values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logspark.operators import access as AC
from logspark.operators import ml as ML
from logspark.operators import quantiles as Q
from logspark.operators.buckets import bucketed

T0 = dt.datetime(2024, 1, 1)
NAMES = ("first", "p50", "p95", "last")


def ranks():
    n = F.col("n")
    return dict(zip(NAMES, (F.lit(0), F.floor(n / 2), Q.nearest_rank(n, 0.95), n - 1), strict=True))


def by_hand(values):
    s = sorted(values)
    n = len(s)
    return [float(s[0]), float(s[n // 2]), float(s[min(int(0.95 * n), n - 1)]), float(s[-1])]


def skewed(rng, kind, n):
    if kind == "outlier":
        return [rng.randint(0, 900) for _ in range(n)] + [10**9, -10**9]
    if kind == "powers":
        return [2.0 ** rng.randint(-300, 300) for _ in range(n)]
    if kind == "equal":
        return [7] * n
    return [rng.random() ** 9 * 1e6 for _ in range(n)]


@pytest.mark.parametrize("kind", ["outlier", "powers", "equal", "dense"])
def test_small_steps_give_the_same_ranks(spark, kind):
    values = skewed(random.Random(4), kind, 2500)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    row = Q.order_statistics(df, "v", ranks(), step_values=20).first()
    assert [row[name] for name in NAMES] == by_hand(values)
    assert (row["n"], row["min"], row["max"]) == (len(values), min(values), max(values))
    assert row["average"] == pytest.approx(sum(values) / len(values))


def test_many_groups_at_once(spark):
    rng = random.Random(6)
    groups = {("hot", "a"): skewed(rng, "outlier", 4000), ("hot", None): skewed(rng, "dense", 900), (None, None): [3, 1, 2],
              ("one", "b"): [5]}
    rows = [(*k, float(v)) for k, vs in groups.items() for v in vs] + [("empty", "c", None)]
    df = spark.createDataFrame(rows, "x string, y string, v double").repartition(7)
    out = Q.grouped_order_statistics(df, ["x", "y"], "v", ranks(), step_values=50).collect()
    assert {(r["x"], r["y"]): [r[name] for name in NAMES] for r in out} == {k: by_hand(v) for k, v in groups.items()}


def test_no_values(spark):
    assert Q.order_statistics(spark.createDataFrame([(None,)], "v double"), "v", ranks()).collect() == []


def test_a_step_of_a_million_values_holds_one_per_cent(spark):
    """Splitters follow the values: an outlier of 10^9 does not draw them away."""
    df = spark.range(1_000_000).selectExpr("CAST(id * 0.001 AS double) AS v").union(spark.range(1).selectExpr("1e9 AS v"))
    cuts = df.agg(F.percentile_approx("v", [i / Q.STEPS for i in range(1, Q.STEPS)], 20 * Q.STEPS).alias("cuts"))
    steps = df.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda s: s <= F.col("v"))).alias("step")).count()
    assert steps.agg(F.max("count")).first()[0] <= 10_000
    row = Q.order_statistics(df, "v", ranks(), step_values=10_000).first()
    assert [row[name] for name in NAMES] == [0.0, 500.0, pytest.approx(950.0), 1e9]


def burst(spark, n=6000):
    """All but a few rows of one source within one second, a third at one moment."""
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(microseconds=500_000 if i % 3 == 0 else rng.randint(0, 999_999)), "hot") for i in range(n)]
    rows += [(n + i, T0 + dt.timedelta(days=40 * i), "hot") for i in range(1, 6)]
    rows += [(n + 10 + i, T0 + dt.timedelta(hours=i), None if i % 2 else "cold") for i in range(40)]
    rows += [(n + 100 + i, None, "hot") for i in range(300)]
    return rows, spark.createDataFrame(rows, "id bigint, log_ts timestamp_ntz, source string").repartition(5)


def test_a_burst_is_cut_into_small_pieces(spark):
    _, df = burst(spark)
    pieces = bucketed(df, ["source"], ["log_ts", "id"], 100).groupBy("_key", "_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("log_ts", "id")).alias("a"), F.max(F.struct("log_ts", "id")).alias("b"))
    hot = pieces.filter("_key.source = 'hot'").orderBy("_bucket").collect()
    assert max(r["n"] for r in hot) <= 200 and sum(r["n"] for r in hot) == 6305 and len(hot) < 6305 / 10
    none = lambda s: (s["log_ts"] is not None, s["log_ts"] or T0, s["id"])
    assert all(none(x["b"]) < none(y["a"]) for x, y in zip(hot, hot[1:]))


def test_ranks_and_gaps_of_a_burst(spark):
    rows, df = burst(spark)
    want = {}
    for key in {r[2] for r in rows}:
        mine = sorted((r[1] is not None, r[1] or T0, r[0]) for r in rows if r[2] == key)
        want |= {i: nr for nr, (_, _, i) in enumerate(mine, 1)}
    assert {r["id"]: r["rank"] for r in AC.rank_within(df, ["source"], ["log_ts", "id"], 100).collect()} == want
    errors = df.withColumns({"level": F.lit("error"), "message": F.lit("m")})
    gaps = {r["id"]: r["gap_seconds"] for r in ML.error_gaps(errors, rows_per_bucket=100).filter("source = 'hot'").collect()}
    timed = sorted((r[1], r[0]) for r in rows if r[2] == "hot" and r[1])
    assert gaps == {b[1]: None if a is None else pytest.approx((b[0] - a[0]).total_seconds())
                    for a, b in zip([None, *timed], timed)}
