"""Pieces of bounded size for groups of any size.

A window over a group that holds a third of all rows would sort them in one
task.  A group with more than ``rows_per_bucket`` rows is cut into pieces of
its order (time, then id) instead: equal steps between its first and last
value, and every piece that is still too large, such as a burst within one
second, again between its own first and last, until all are small.  Rows of
one time are cut by id.

Each level's borders are written once, so every evaluation of the plan puts a
row into the same piece, whatever the planner reuses, prunes or samples.
Levels after the first look at the rows of too large pieces only; without
large groups there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.scratch import written

ROWS_PER_BUCKET = 100_000
_NULL = -(1 << 62)                                         # before any time


def _number(df: DataFrame, name: str) -> Column:
    """A column as a long in its own order, nulls first."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    number = F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("bigint")
    return F.coalesce(number, F.lit(_NULL))


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with ``_key`` (struct of the keys; equal also where they are
    null) and ``_bucket`` (array of numbers), growing with ``order`` inside a
    key.  ``order``: a time column and whole-number columns.  No bucket has
    more than ``rows_per_bucket`` rows, but for rows equal in all of them."""
    order = [order] if isinstance(order, str) else list(order)
    values = [f"_v{i}" for i in range(len(order))]
    rows = df.withColumns({"_key": F.struct(*[F.col(k) for k in keys]), "_bucket": F.array().cast("array<bigint>"),
                           **{v: _number(df, o) for v, o in zip(values, order, strict=True)}})
    pieces, level = rows, 0
    while True:
        large = _large(pieces, values, rows_per_bucket)
        large = written(large, "bucket_borders")
        if large.isEmpty():
            break
        rows = _cut(rows, large, values)
        # the next level asks about the rows of cut pieces alone
        pieces = rows.filter(F.size("_bucket") == level + 1)
        level += 1
    return rows.drop(*values)


def _large(pieces: DataFrame, values: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """Borders of the pieces with too many rows: the first order column that
    is not all the same is cut into ``parts``."""
    spans = pieces.groupBy("_key", "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("lo", F.min), ("hi", F.max))])
    which = lo = hi = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        differs = F.col(f"{v}_lo") < F.col(f"{v}_hi")
        which = F.when(differs, F.lit(i)).otherwise(which)
        lo = F.when(differs, F.col(f"{v}_lo")).otherwise(lo)
        hi = F.when(differs, F.col(f"{v}_hi")).otherwise(hi)
    return (spans.filter(F.col("_rows") > rows_per_bucket)
            .select("_key", "_bucket", which.cast("int").alias("_which"), lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"),
                    (2 * F.ceil(F.col("_rows") / F.lit(rows_per_bucket))).cast("bigint").alias("_parts"))
            .filter(F.col("_which").isNotNull()))


def _cut(rows: DataFrame, large: DataFrame, values: Sequence[str]) -> DataFrame:
    value = F.lit(None).cast("bigint")
    for i, v in enumerate(values):
        value = F.when(F.col("_which") == i, F.col(v)).otherwise(value)
    exact = lambda c: c.cast("decimal(20,0)")
    share = (exact(value) - exact(F.col("_lo"))).cast("double") / (exact(F.col("_hi")) - exact(F.col("_lo"))).cast("double")
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1).cast("bigint")
    joined = rows.join(large, ["_key", "_bucket"], "left")
    bucket = F.when(F.col("_which").isNotNull(), F.concat("_bucket", F.array(part))).otherwise(F.col("_bucket"))
    return joined.withColumn("_bucket", bucket).drop("_which", "_lo", "_hi", "_parts")
