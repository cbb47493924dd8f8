"""Pattern detection: frequent terms, error signatures, message clusters.

Grouping keys here (patterns, signatures, terms) can be high-cardinality and
skewed; every aggregate is algebraic (count, min, max, list of distinct sources), so partial aggregation collapses a hot key inside each map task.  Samples per
cluster use ``row_number() <= 3``, which Spark turns into a partial
``WindowGroupLimit`` before the shuffle, so no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.normalize import enrich


def _e(df: DataFrame, *cols) -> DataFrame:
    return enrich(df, cols=cols)


def frequent_terms(df: DataFrame, top: int = 20) -> DataFrame:
    """Top ``top`` words (3+ letters, no stop words) across all messages."""
    words = df.select(F.explode(X.terms("message")).alias("term"))
    return (words.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("term")).limit(top))


def _by_error_pattern(df: DataFrame, *keys) -> DataFrame:
    """Error/fatal rows per pattern (and ``keys``): count, first and last time.

    Empty patterns are left out by an aggregate: a filter on the pattern
    itself would be pushed below and run its chain of rules twice per row."""
    e = _e(df, "is_narrow_error", "pattern").filter("is_narrow_error")
    return (e.groupBy("pattern", *keys)
            .agg(F.count(F.lit(1)).alias("count"), F.min("log_ts").alias("first_seen"), F.max("log_ts").alias("last_seen"),
                 F.max("pattern").alias("_p")).filter(F.col("_p") != "").drop("_p"))


def error_signatures(df: DataFrame) -> DataFrame:
    """Error/fatal patterns seen more than once: count, sources, first/last seen.

    Rows are first counted by (pattern, source), so the list of a pattern's
    sources is gathered from one row per source."""
    return (_by_error_pattern(df, "source").groupBy("pattern")
            .agg(F.sum("count").alias("count"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
                 F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
            .filter(F.col("count") > 1))


def error_signature_sources(df: DataFrame) -> DataFrame:
    """The sources of each error/fatal pattern seen more than once, one row
    each with their count: the list of :func:`error_signatures` as rows."""
    per = _by_error_pattern(df, "source").select("pattern", "source", "count")
    seen = per.groupBy("pattern").agg(F.sum("count").alias("seen")).filter(F.col("seen") > 1)
    return per.join(seen.select("pattern"), "pattern").select("pattern", "source", "count")


def message_signature_counts(df: DataFrame) -> DataFrame:
    return (_e(df, "signature").groupBy("signature").agg(F.count(F.lit(1)).alias("count")))


def message_clusters(df: DataFrame, top: int = 10) -> DataFrame:
    """Top ``top`` clusters (3 sorted distinct 4+-letter words) with > 1 message."""
    return (_e(df, "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") > 1)
            .orderBy(F.col("count").desc(), F.col("cluster")).limit(top))


def cluster_samples(df: DataFrame, top: int = 10, k: int = 3) -> DataFrame:
    """First ``k`` messages (by id) of each of the top clusters."""
    e = _e(df, "cluster")
    tops = message_clusters(e, top).select("cluster")          # at most ``top`` rows
    w = Window.partitionBy("cluster").orderBy("id")
    # only the messages of the chosen clusters are ranked
    firsts = (e.select("cluster", "id", "message").join(F.broadcast(tops), "cluster")
              .withColumn("sample_rank", F.row_number().over(w))
              .filter(F.col("sample_rank") <= k))
    return firsts.select("cluster", F.col("sample_rank").cast("bigint").alias("sample_rank"), "id", "message")
