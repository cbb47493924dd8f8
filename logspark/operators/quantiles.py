"""Exact order statistics of any number of values, for one group or many.

1. The values are counted once (group, value, how often) and written: the
   histogram.  Its shuffle key holds the value, so a hot group is spread.
2. A group with more than ``STEP_VALUES`` distinct values is cut at splitters,
   ``STEPS`` approximate quantiles of its distinct values.  Splitters follow
   the values, so outliers and bursts do not draw them away: a step holds about
   one ``STEPS``-th of the values.  The counts between splitters tell which
   step holds a wanted rank; only these steps are kept, and cut again until
   each is small.
3. The values of the last steps are summed up one by one.

Splitters are approximate, the counts between them are not: results are exact
at every size, the rows are read once and no task holds more than
``STEP_VALUES`` values of a group (a single value is one row).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.scratch import written

STEPS = 128
STEP_VALUES = 100_000


def histogram(values: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """(keys, v, c): each value and how often it stands, written; nulls are not values."""
    # Nulls are left out by their count: a filter on the value itself would be
    # pushed below and evaluate the value's expression a second time per row.
    counts = values.groupBy(*keys, F.col(col).alias("v")).agg(F.count(col).alias("c")).filter(F.col("c") > 0)
    return written(counts, "histogram")


def select_ranks(counts: DataFrame, keys: Sequence[str], targets: DataFrame, step_values: int = STEP_VALUES,
                 steps: int = STEPS) -> DataFrame:
    """(keys, name, v) for ``targets`` (keys, name, k): the value of 0-based
    rank k in the histogram ``counts`` of its group."""
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("one"))
    pool = counts.select(group.alias("g"), F.lit("").alias("step"), "v", "c")
    wanted = targets.select(group.alias("g"), F.lit("").alias("step"), "name", "k", *keys)
    level = 0
    while True:
        large = (pool.groupBy("g", "step").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") > step_values)
                 .select("g", "step"))
        large = written(large, "large_steps") if level else large
        if large.isEmpty():
            break
        level += 1
        pool, wanted = _narrowed(pool, wanted, large, keys, steps)
    upto = F.sum("c").over(Window.partitionBy("g", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = pool.withColumn("upto", upto).join(wanted, ["g", "step"]).filter(F.col("upto") > F.col("k"))
    return found.groupBy(*keys, "name").agg(F.min("v").alias("v"))


def _narrowed(pool: DataFrame, wanted: DataFrame, large: DataFrame, keys, steps: int) -> tuple[DataFrame, DataFrame]:
    """Large steps cut at splitters; of the pieces those that hold a wanted
    rank stay, and ranks count from their piece's start."""
    cuts = F.percentile_approx("v", [i / steps for i in range(1, steps)], 20 * steps).alias("cuts")
    splitters = pool.join(large, ["g", "step"], "left_semi").groupBy("g", "step").agg(cuts)
    inner = F.concat("step", F.lit("/"), F.size(F.filter("cuts", lambda s: s <= F.col("v"))).cast("string"))
    place = F.size(F.filter("cuts", lambda s: s <= F.col("v")))
    cut = (pool.join(splitters, ["g", "step"], "left")
           .select("g", "step", "v", "c", F.when(F.col("cuts").isNotNull(), place).otherwise(-1).alias("piece"),
                   F.when(F.col("cuts").isNotNull(), inner).otherwise(F.col("step")).alias("inner")))
    cut = written(cut, "steps")
    sums = cut.groupBy("g", "step", "inner", "piece").agg(F.sum("c").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g", "step").orderBy("piece")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    held = (wanted.join(sums, ["g", "step"])
            .filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c")))
            .select("g", F.col("inner").alias("step"), "name", (F.col("k") - F.col("before")).alias("k"), *keys))
    held = written(held, "wanted_ranks")
    kept = (cut.select("g", F.col("inner").alias("step"), "v", "c")
            .join(held.select("g", "step").distinct(), ["g", "step"], "left_semi"))
    return written(kept, "steps"), held


def grouped_order_statistics(values: DataFrame, keys: Sequence[str], col: str, ranks: Mapping[str, Column],
                             more: Mapping[str, Column] | None = None, step_values: int = STEP_VALUES) -> DataFrame:
    """One row per group with values: keys, n, average, min, max, and for each
    name the element with that 0-based rank of the group's sorted values;
    ranks are expressions of ``n``.  ``more``: further aggregates over (v, c),
    a value and how often it stands.  Groups of null keys count as any other."""
    keys = list(keys)
    counts = histogram(values, keys, col)
    totals = counts.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("average"), F.min("v").alias("min"),
        F.max("v").alias("max"), *[c.alias(name) for name, c in (more or {}).items()]).filter(F.col("n") > 0)
    targets = totals.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("k")) for name, rank in ranks.items()])).alias("w"))
    picked = select_ranks(counts, keys, targets.select(*keys, "w.name", "w.k"), step_values)
    picked = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v").cast("double"))).alias(name) for name in ranks])
    if not keys:
        return totals.crossJoin(F.broadcast(picked))       # one row
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return totals.alias("t").join(picked.alias("p"), on).select("t.*", *[f"p.{name}" for name in ranks])


def order_statistics(values: DataFrame, col: str, ranks: Mapping[str, Column],
                     more: Mapping[str, Column] | None = None, step_values: int = STEP_VALUES) -> DataFrame:
    """The one row of all values together; no row without values."""
    return grouped_order_statistics(values, (), col, ranks, more, step_values)


def median_ranks(n: Column) -> dict[str, Column]:
    """The ranks whose mean is the median."""
    return {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)}


def exclusive_ranks(n: Column, i: int, m: int) -> dict[str, Column]:
    """The ranks between which cut point i of m quantiles lies by the
    'exclusive' method (n >= 2)."""
    j = _exclusive_j(n, i, m)
    return {"cut_lower": F.greatest(j - 1, F.lit(0)), "cut_upper": F.greatest(F.least(j, n - 1), F.lit(0))}


def exclusive_quantile(n: Column, i: int, m: int) -> Column:
    delta = (n + 1) * i - _exclusive_j(n, i, m) * m
    return (F.col("cut_lower") * (m - delta) + F.col("cut_upper") * delta) / F.lit(float(m))


def _exclusive_j(n: Column, i: int, m: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor((n + 1) * i / m), n - 1))


def nearest_rank(n: Column, q: float) -> Column:
    """0-based rank int(q * n) used by the performance distribution."""
    return F.least(F.floor(n * F.lit(q)), n - 1)
