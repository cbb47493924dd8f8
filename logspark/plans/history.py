"""Report history kept as facts of each stored day.

A *history table* has one partition per day with that day's log facts (rows
per source, level and hour, weights and timings): at most sources x levels x
24 rows a day.  Facts add up, so the report of any day, over all logs up to
its end, follows from running sums over days; no log is read again.

``refresh`` recomputes the given days (or all) and replaces their partitions
alone (dynamic partition overwrite): run twice, or for a day whose logs came
late, the table is the same as if written once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import levels as L
from ..functions import text as X
from ..sources.normalize import normalize_logs

FACTS = "source string, level string, hour bigint, c bigint, rt_n bigint, rt_sum double, slow bigint, day date"


def daily_facts(logs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """FACTS of every day with logs (those without a time belong to no day)."""
    n = normalize_logs(logs.filter(F.col("log_ts").isNotNull()))
    rt = X.response_time("message", cfg.unit_mode)
    return (n.groupBy("source", "level", F.hour("log_ts").cast("bigint").alias("hour"), F.to_date("log_ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("c"), F.count(rt).alias("rt_n"), F.sum(rt).cast("double").alias("rt_sum"),
                 F.count(F.when(rt > cfg.performance_threshold_ms, 1)).alias("slow"))
            .select(*[f.strip().split(" ")[0] for f in FACTS.split(",")]))


def refresh(logs: DataFrame, path: str, days: Iterable | None = None, cfg: EngineConfig = DEFAULT) -> None:
    """Write the facts of ``days`` (dates; None: every day that has logs)."""
    if days is not None:
        days = [str(x) for x in days]
        day = F.to_date("log_ts")                          # the bounds reach the scan, days in between do not
        logs = logs.filter(F.col("log_ts").between(F.lit(min(days)).cast("timestamp_ntz"),
                                                   F.expr(f"DATE'{max(days)}' + INTERVAL 1 DAY").cast("timestamp_ntz")))
        logs = logs.filter(day.isin([F.lit(x).cast("date") for x in days]))
    (daily_facts(logs, cfg).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def _running(df: DataFrame, over, *names) -> DataFrame:
    w = Window.partitionBy(*over).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.sum(n).over(w) for n in names})


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored day: the report's figures over all logs up to the
    end of that day, and their change since the stored day before."""
    f = spark.read.schema(FACTS).parquet(path)
    broad = L.is_broad_error(F.col("level"))
    by_day = f.groupBy("day").agg(
        F.sum("c").alias("total_logs"), F.sum(F.when(broad, F.col("c")).otherwise(0)).alias("total_errors"),
        F.sum(F.col("c") * L.severity_weight("level")).alias("weight"), F.sum("rt_n").alias("timed_operations"),
        F.sum(F.coalesce("rt_sum", F.lit(0.0))).alias("time"), F.sum("slow").alias("slow_operations"))
    first_days = f.groupBy("source").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("source_count"))
    # rows of the next two windows are days, and days x hours of the day
    totals = _running(by_day.join(first_days, "day", "left").fillna(0, ["source_count"]), (),
                      "total_logs", "total_errors", "weight", "timed_operations", "time", "slow_operations", "source_count")
    grid = by_day.select("day").crossJoin(F.broadcast(spark.range(24).select(F.col("id").alias("hour"))))
    hours = grid.join(f.groupBy("day", "hour").agg(F.sum("c").alias("c")), ["day", "hour"], "left").fillna(0, ["c"])
    seen = _running(hours, ("hour",), "c").filter(F.col("c") > 0)
    spread = seen.groupBy("day").agg(F.avg("c").alias("volume_mean"), F.coalesce(F.stddev_samp("c"), F.lit(0.0)).alias("volume_std"))
    r = totals.join(spread, "day")
    rate = F.col("total_errors") * 100.0 / F.col("total_logs")
    r = r.select("day", "total_logs", "total_errors", rate.alias("error_rate"), (F.col("weight") / F.col("total_logs")).alias("severity_score"),
                 "source_count", F.when(F.col("timed_operations") > 0, F.col("time") / F.col("timed_operations")).alias("average_response_time"),
                 "slow_operations", "volume_mean", "volume_std")
    steady = F.when(F.col("volume_std") > 0, F.greatest(F.lit(0.0), 20.0 - F.col("volume_std") / F.col("volume_mean") * 10)).otherwise(20.0)
    score = (F.greatest(F.lit(0.0), 40.0 - F.col("error_rate") * 2) + F.greatest(F.lit(0.0), 20.0 - F.col("severity_score"))
             + steady + F.least(F.lit(20.0), F.col("source_count") * 2.0))
    r = r.withColumn("score", score).withColumn("grade", L.reliability_grade(F.col("score")))
    before = Window.orderBy("day")                          # one row per stored day
    return r.drop("volume_mean", "volume_std").withColumns({
        "error_rate_change": F.col("error_rate") - F.lag("error_rate").over(before),
        "score_change": F.col("score") - F.lag("score").over(before),
        "new_logs": F.col("total_logs") - F.coalesce(F.lag("total_logs").over(before), F.lit(0))})
