"""Mergeable daily history: statistics rolled up to any longer window without reading the table again.

Each day and column keeps counts, sums and two sketches.  Counts, sums, minima
and maxima merge exactly.  Distinct counts (HyperLogLog) and quantiles (KLL) are
estimates; ``DISTINCT_ERROR`` and ``RANK_ERROR`` are what the sketches' sizes
allow, at every roll-up, as merging adds no error of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers; three standard errors of the estimate, 3 * 1.04 / sqrt(2^LG).
LG = 12
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG / 2)
#: KLL's parameter, and the share of all values by which a rank may be off at this size (99 % of the time).
K = 200
RANK_ERROR = 0.0165
#: The parts of a window that merge exactly.
SUMS = ("records", "null_count", "n", "sx", "sxx")


def daily_history(df: DataFrame, ts: str, numeric) -> DataFrame:
    """day, column_name, counts, sums, extremes and sketches: one pass over the table, one row per day and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in numeric])
    x = F.col("x")
    long = df.select(F.to_date(ts).alias("day"), F.inline(pairs))
    return long.groupBy("day", "column_name").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(x.isNull()).alias("null_count"), F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(LG)).alias("distinct"),
        F.kll_sketch_agg_double(x, F.lit(K)).alias("ranks"))


def rolled_up(history: DataFrame, granularity: str, shares=(0.25, 0.5, 0.75)) -> DataFrame:
    """Windows of ``granularity`` (week, month, ...) from stored days, by merging alone."""
    window = F.date_trunc(granularity, "day").cast("date").alias("window_start")
    merged = history.groupBy(window, "column_name").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"))
    n = F.col("n")
    quantiles = F.when(n > 0, F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(float(s)) for s in shares])))
    spread = F.sqrt(F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1), F.lit(0.0)))
    return merged.select(
        F.lit(granularity).alias("granularity"), "window_start", "column_name", "records", "null_count",
        F.hll_sketch_estimate("distinct").alias("distinct_estimate"),
        (F.col("sx") / n).alias("mean"), F.when(n > 1, spread).alias("stddev"), "min_value", "max_value", quantiles.alias("quantiles"))


def append_days(df: DataFrame, path: str, ts: str, numeric) -> None:
    """Store the days of ``df``; a day that is delivered again replaces its own rows, so a replay adds nothing."""
    days = daily_history(df, ts, numeric)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def rank_share(values: DataFrame, by, x: str, at: str) -> DataFrame:
    """Share of the values below and up to ``at``, per group: what a quantile estimate is held against."""
    return values.groupBy(*by).agg(
        (F.count_if(F.col(x) < F.col(at)) / F.count(x)).alias("below"), (F.count_if(F.col(x) <= F.col(at)) / F.count(x)).alias("upto"))
