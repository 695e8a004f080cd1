"""Exact percentiles without gathering a group's values in one task.

The values are first reduced to a histogram of distinct values per group, whose
shuffle key includes the value.  One small sketch over all distinct values cuts
the value axis into slices of similar size, so no (group, slice) pair can hold
more than that share of the histogram, however large its group.  Counts per
slice tell which slices hold the wanted ranks, and only those are sorted.  The
sketch decides where the cuts fall, never the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqflow.operators.skew import as_list, stored_lookup
from dqflow.sources.tables import stored_layer

HALVINGS = 12  # up to 4096 slices


def _cuts(hist: DataFrame) -> DataFrame:
    """One row: the sorted cut points."""
    n = 2**HALVINGS
    # One text literal instead of thousands of number literals: plans stay small.
    steps = F.split(F.lit(",".join(str(i / n) for i in range(1, n))), ",").cast("array<double>")
    return hist.agg(F.array_distinct(F.percentile_approx("_v", steps, n)))


def _slice_of(cuts: Column, v: Column) -> Column:
    """Number of cut points below ``v`` by halving."""
    strides = F.array(*[F.lit(2**i) for i in reversed(range(HALVINGS))])
    found = F.aggregate(
        strides, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < v, at + step).otherwise(at)
    )
    # Never NULL, so that the join on the slice adds no filter that would be
    # evaluated on the raw rows below the aggregation.
    return F.coalesce(found, F.lit(0))


def histogram(df: DataFrame, by, value: str, weight: str | None = None) -> DataFrame:
    """How often (``_c``) each value (``_v``) occurs per group, written once for all that is read from it."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*[F.col(c) for c in as_list(by)], F.col(value).cast("double").alias("_v"))
    return stored_layer(hist.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")), "histogram")


def exact_percentiles(df: DataFrame, by, value: str, wanted: dict, weight: str | None = None, interpolate: bool = True) -> DataFrame:
    """One row per group with a double column per entry of ``wanted``.

    ``wanted`` maps an output name to a fraction; ranks between two values are
    interpolated linearly, or taken as the upper of the two.  NULL values are ignored.  ``_n`` holds the number of
    values.  With ``weight`` a row stands for that many equal values.
    """
    return histogram_percentiles(histogram(df, by, value, weight), by, wanted, interpolate)


def histogram_percentiles(hist: DataFrame, by, wanted: dict, interpolate: bool = True) -> DataFrame:
    """``exact_percentiles`` of a stored ``histogram``: values travel only in slices that hold a rank."""
    by = as_list(by)
    cut = hist.withColumn("_cuts", _cuts(hist).scalar())
    sliced = cut.withColumn("_slice", _slice_of(F.col("_cuts"), F.col("_v"))).drop("_cuts")
    counts = sliced.groupBy(*by, "_slice").agg(F.sum("_c").alias("_sc"))
    part = W.partitionBy(*by)
    upto = part.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    located = counts.withColumns(
        {"_end": F.sum("_sc").over(upto), "_n": F.sum("_sc").over(part)}
    ).withColumn("_start", F.col("_end") - F.col("_sc"))

    ranks = []
    for name, p in wanted.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        ranks.append((name, F.floor(pos), F.ceil(pos), pos - F.floor(pos)))

    def holds(rank, start, end):
        return (rank >= start) & (rank < end)

    any_rank = F.lit(False)
    for _, lo, hi, _ in ranks:
        any_rank = any_rank | holds(lo, F.col("_start"), F.col("_end")) | holds(hi, F.col("_start"), F.col("_end"))
    targets = located.where(any_rank).select(*by, "_slice", "_start", "_n")
    inner = W.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    targets, small = stored_lookup(targets)
    picked = (
        sliced.join(F.broadcast(targets) if small else targets, [*by, "_slice"])
        .withColumn("_stop", F.col("_start") + F.sum("_c").over(inner))
        .withColumn("_begin", F.col("_stop") - F.col("_c"))
    )
    aggs = [F.max("_n").alias("_n")]
    for name, lo, hi, frac in ranks:
        low = F.max(F.when(holds(lo, F.col("_begin"), F.col("_stop")), F.col("_v")))
        high = F.max(F.when(holds(hi, F.col("_begin"), F.col("_stop")), F.col("_v")))
        aggs.append((low + (high - low) * F.max(frac) if interpolate else high).alias(name))
    return picked.groupBy(*by).agg(*aggs)
