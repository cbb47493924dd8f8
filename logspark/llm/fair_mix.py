"""Mixing sources to target weights by weighted fair queueing.

Every document is placed in its source's shuffled order; its virtual finish
time is the source's cumulative tokens up to and with it, divided by the
source's target.  A source that must give more than it has is passed
through again (up to ``MAX_PASSES`` times).  The items of all sources are
taken in the order of their finish times until the total budget is spent.

Only DataFrame functions are used.  Running sums are taken in two levels:
a window inside buckets of the ordering value, and a running sum over one
row per bucket, so that a source with a third of all rows is spread over
many tasks.  The buckets are fixed expressions of the rows, not partitions.

Null or empty texts have size 0 and are never taken.  Null is a source of
its own, the last.  Repeated rows are separate documents.  Equal finish
times are ordered by source, pass, shuffle value and doc_id.  A very long
text counts with all its words; an empty table gives no rows.  ``mix`` reads
doc_id, text and source only; ``repeated`` carries all other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .scratch import Scratch
from .words import PLAIN_SQL

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKET_ROWS = 4_000
BUCKETS = 4096                 # per level of the search for the cut
SEED = "mix:"


def text_size(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(PLAIN_SQL)), F.lit(0)).cast("long")


def shuffle_value(doc_id) -> F.Column:
    """A repeatable place in [0, 1) for a document, from 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: key, source_size, source_rows, weight, target.

    ``sizes`` has (key, size).  The targets share the total of all sizes by
    weight; those above ``max_passes`` times their source stop there and the
    rest is shared again.  Sorted by size / weight the stopped sources come
    first, so one running sum settles all rounds.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    every = Window.partitionBy()
    numbered = (per.withColumn("nr", F.row_number().over(Window.orderBy("key")) - 1)
                .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                                                   (F.col("nr") % len(WEIGHTS) + 1).cast("int")).cast("long"))
                .withColumn("total", F.sum("source_size").over(every)))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(0, Window.unboundedFollowing)
    cap = F.lit(max_passes) * F.col("source_size")
    left = F.col("total") - F.lit(max_passes) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shared = (numbered.withColumn("left", left).withColumn("weights_left", F.sum("weight").over(after))
              .withColumn("stopped", cap * F.col("weights_left") <= F.col("weight") * F.col("left")))
    stopped = F.col("stopped")
    rate = (shared.where(~stopped).orderBy(F.col("source_size") / F.col("weight"), "key").limit(1)
            .select(F.col("left").alias("free"), F.col("weights_left").alias("free_weights")))
    return (shared.join(F.broadcast(rate), F.lit(True), "left")
            .withColumn("target", F.when(stopped | F.col("free").isNull(), cap.cast("double"))
                        .otherwise(F.col("weight") * F.col("free") / F.col("free_weights")))
            .select("key", "source_size", "source_rows", "weight", "target", "total"))


def queue(docs: DataFrame, scratch: Scratch, *carried: str) -> DataFrame:
    """The ``carried`` columns, doc_id, key, size, place, upto (the source's cumulative size with this
    document), source_size, target, total: the shuffled queue of each source."""
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    sizes = scratch.write(docs.select(*carried, "doc_id", key.alias("key"), text_size(F.col("text")).alias("size")), "sizes")
    targets = scratch.write(source_targets(sizes).coalesce(1), "targets")
    buckets = F.ceil(F.col("source_rows") / F.lit(BUCKET_ROWS))
    placed = (sizes.join(targets, "key").withColumn("place", shuffle_value(F.col("doc_id")))
              .withColumn("bucket", F.floor(F.col("place") * buckets)))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size", *carried).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ordered = placed.withColumn("within", F.sum("size").over(inside))
    return (ordered.join(starts, ["key", "bucket"]).withColumn("upto", F.col("start") + F.col("within"))
            .select(*carried, "doc_id", "key", "size", "place", "upto", "source_size", "target", "total"))


def finish_time(nr) -> F.Column:
    """Virtual finish time of the document's ``nr``-th pass, from 0; null in
    a source without words."""
    return F.try_divide((nr * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def mix(docs: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) for every row."""
    return decided(docs, Scratch(docs.sparkSession, "fair-mix"), max_passes)


def decided(docs: DataFrame, scratch: Scratch, max_passes: int, *carried: str) -> DataFrame:
    """``mix`` with the ``carried`` columns of ``docs``."""
    queued = scratch.write(queue(docs, scratch, *carried), "queue")
    # At time 1 every source has given at most its target, so the total is
    # within the budget; the rest goes to items that finish later, in order.
    in_time = sum((F.when(finish_time(F.lit(nr)) <= 1, 1).otherwise(0) for nr in range(max_passes)), F.lit(0))
    spent = queued.agg(F.sum(in_time * F.col("size")).alias("spent"), F.max("total").alias("budget"))
    spent = scratch.write(spent.coalesce(1), "spent")
    late = (queued.where("size > 0").withColumn("nr", F.explode(F.array(*[F.lit(i) for i in range(max_passes)])))
            .withColumn("finish", finish_time(F.col("nr"))).where("finish > 1")
            .select("finish", "key", "nr", "place", "doc_id", "size"))
    last = cut(late, spent, scratch)
    order = ("finish", "key", "nr", "place", "doc_id")
    item = lambda nr: F.struct(finish_time(F.lit(nr)).alias("finish"), F.col("key"), F.lit(nr).alias("nr"),
                               F.col("place"), F.col("doc_id"))
    bound = F.struct(*[F.col(f"last_{c}").alias(c) for c in order])
    passes = sum((F.when((finish_time(F.lit(nr)) <= 1) | F.coalesce(item(nr) <= bound, F.lit(False)), 1).otherwise(0)
                  for nr in range(max_passes)), F.lit(0))
    return (queued.join(F.broadcast(last), F.lit(True), "left")
            .select(*carried, "doc_id", F.substring("key", 2, 1 << 30).alias("_name"), "key", "size", "source_size", "target",
                    F.when(F.col("size") > 0, F.col("size") * passes).otherwise(0).cast("long").alias("taken"))
            .withColumn("source", F.when(F.col("key") != "1", F.col("_name")))
            .select(*carried, "doc_id", "source", "size", "source_size", "target", "taken"))


def cut(items: DataFrame, spent: DataFrame, scratch: Scratch) -> DataFrame:
    """The last of ``items`` that still fits the budget, one row (none: no
    row).  The finish times are searched in two levels of ``BUCKETS`` equal
    steps; only the items of one step of the second level meet in a task."""
    slack = spent.select((F.col("budget") - F.col("spent")).alias("slack"))
    bounds = items.agg(F.min("finish").alias("lo"), F.max("finish").alias("hi"))
    here = items.join(F.broadcast(bounds), F.lit(True))
    base = scratch.write(slack.withColumn("before", F.lit(0).cast("long")), "slack")
    for level in (1, 2):
        width = F.col("hi") - F.col("lo")
        step = F.when(width > 0, F.least(F.floor((F.col("finish") - F.col("lo")) / width * BUCKETS),
                                         F.lit(BUCKETS - 1))).otherwise(0)
        stepped = here.withColumn("step", step)
        sums = stepped.groupBy("step").agg(F.sum("size").alias("step_size"), F.min("finish").alias("step_lo"),
                                           F.max("finish").alias("step_hi"))
        running = sums.withColumn("upto", F.sum("step_size").over(Window.orderBy("step")))
        crossing = (running.join(F.broadcast(base), F.lit(True)).where("before + upto > slack")
                    .orderBy("step").limit(1)
                    .select(F.col("step_lo").alias("lo"), F.col("step_hi").alias("hi"), "slack",
                            (F.col("before") + F.col("upto") - F.col("step_size")).alias("before")))
        found = scratch.write(crossing, f"crossing{level}")
        here = items.join(F.broadcast(found.select("lo", "hi")), F.col("finish").between(F.col("lo"), F.col("hi")))
        base = found.select("slack", "before")
    order = [F.col(c) for c in ("finish", "key", "nr", "place")] + [F.col("doc_id").asc_nulls_first()]
    running = here.withColumn("upto", F.sum("size").over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = running.join(F.broadcast(base), F.lit(True)).where("before + upto <= slack")
    lower = items.join(F.broadcast(found.select("lo", "hi")), F.col("finish") < F.col("lo"))
    columns = ["finish", "key", "nr", "place", "doc_id"]
    last = fits.select(*columns).unionByName(lower.select(*columns)).agg(F.max(F.struct(*columns)).alias("last"))
    return scratch.write(last.where("last is not null")
                         .select(*[F.col(f"last.{c}").alias(f"last_{c}") for c in columns]).coalesce(1), "last")


def repeated(docs: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` that the mix takes, each as many
    times as it takes them, with a ``mix_pass`` column from 0 (one that ``docs``
    has already, of whatever case, gives way to it)."""
    docs = docs.drop("mix_pass")
    scratch = Scratch(docs.sparkSession, "fair-mix")
    rows, _ = numbered(docs, scratch)
    times = (decided(rows, scratch, max_passes, "_logspark_row").where("taken > 0")
             .select("_logspark_row", (F.col("taken") / F.col("size")).cast("int").alias("_mix_times")))
    return (rows.where(text_size(F.col("text")) > 0).join(times, "_logspark_row")
            .withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)))
            .select(*docs.columns, "mix_pass"))
