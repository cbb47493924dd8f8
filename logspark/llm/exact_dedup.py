"""Exact deduplication with a heavy-hitter split.

1. One pass writes (doc_id, SHA-256 of the normalised text).
2. A Misra-Gries summary of ``k`` counters per task finds the digests that
   may be frequent; summaries are merged by adding counters and keeping the
   ``2 k`` largest, which holds every digest of more than ``2 n / k`` rows.
3. The candidates are counted exactly.  The verified ones, with the doc_id
   that stays, number ``2 k`` at most and are broadcast: their other rows
   are settled in the scan's tasks and never shuffled.
4. All other digests are shuffled as usual; none has more than about
   ``2 n / k`` rows.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty.  The row with the largest doc_id stays (null is smallest); of
repeated rows with that doc_id one stays.  An empty table gives an empty
result.  Further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import LOWER, UPPER

COUNTERS = 512


def text_digest(text) -> F.Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)


def misra_gries(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The summary of one task: at most ``k`` (digest, counter) rows, each
    counter below its true count by n / (k + 1) at most."""
    counters: dict[str, int] = {}
    for batch in batches:
        for entry in pc.value_counts(batch.column(0)).to_pylist():
            counters[entry["values"]] = counters.get(entry["values"], 0) + entry["counts"]
        if len(counters) > k:
            cut = sorted(counters.values(), reverse=True)[k]
            counters = {d: c - cut for d, c in counters.items() if c > cut}
    yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.string()),
                                      pa.array(list(counters.values()), pa.int64())], ["digest", "counter"])


def heavy_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Frequent digests with exact count and the doc_id that stays; at most
    ``2 k`` rows."""
    summaries = digests.select("digest").mapInArrow(lambda it: misra_gries(it, k), "digest string, counter long")
    top = (summaries.groupBy("digest").agg(F.sum("counter").alias("counter"))
           .orderBy(F.desc("counter"), "digest").limit(2 * k).select("digest"))
    return (digests.join(F.broadcast(top), "digest").groupBy("digest")
            .agg(F.max("doc_id").alias("heavy_keep"), F.count("*").alias("heavy_size")).where("heavy_size > 1"))


def decide(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    digests = scratch.write(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    heavy = scratch.write(heavy_digests(digests, k).coalesce(1), "heavy")
    rows = digests.join(F.broadcast(heavy), "digest", "left")
    lost = F.col("heavy_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("heavy_keep"))
    settled = rows.where(lost).select("doc_id", F.col("heavy_keep").alias("keep_id"),
                                      F.col("heavy_size").alias("group_size"), F.lit(False).alias("kept"),
                                      F.col("digest").alias("text_sha256"))
    group = Window.partitionBy("digest")
    rest = (rows.where(~lost)
            .withColumn("rank", F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))))
            .withColumn("keep_id", F.max("doc_id").over(group))
            .withColumn("size", F.count("*").over(group))
            .select("doc_id", "keep_id", F.coalesce("heavy_size", "size").alias("group_size"),
                    (F.col("rank") == 1).alias("kept"), F.col("digest").alias("text_sha256")))
    return settled.unionByName(rest)


def deduplicate(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated
    rows (equal doc_id and text) one stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup-keep")
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keep = scratch.write(decide(docs, k).where("kept")
                         .select(row.alias("_dedup_row"), F.col("text_sha256").alias("_dedup_digest")), "keep")
    marked = docs.withColumns({"_dedup_row": row, "_dedup_digest": text_digest(F.col("text"))})
    return (marked.join(keep, ["_dedup_row", "_dedup_digest"], "left_semi")
            .dropDuplicates(["_dedup_row", "_dedup_digest"]).select(*docs.columns))
