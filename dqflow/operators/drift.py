"""Windowed profiles and distribution drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.scalars import rate


def _pairs(numeric, categorical):
    """Long form: one (column, text value, number) triple per field of a row."""
    return F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text"), F.col(c).cast("double").alias("x")) for c in numeric],
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("text"), F.lit(None).cast("double").alias("x")) for c in categorical],
    )


def window_profile(df: DataFrame, ts: str, granularity: str, numeric=(), categorical=()) -> DataFrame:
    """Null, distinct and moment statistics per time window and column.

    Values are folded to one row per (window, column, value) first, which gives
    the distinct count and keeps a frequent value from travelling twice.
    """
    long = df.select(F.date_trunc(granularity, F.col(ts)).alias("window_start"), F.inline(_pairs(numeric, categorical)))
    folded = long.groupBy("window_start", "column_name", "text", "x").agg(F.count(F.lit(1)).alias("c"))
    n, c, x = F.sum("c"), F.col("c"), F.col("x")
    seen = F.sum(F.when(x.isNotNull(), c))
    sx, sxx = F.sum(x * c), F.sum(x * x * c)
    out = folded.groupBy("window_start", "column_name").agg(
        n.alias("records"),
        F.sum(F.when(F.col("text").isNull(), c).otherwise(0)).alias("null_count"),
        F.count_if(F.col("text").isNotNull()).alias("distinct_count"),
        (sx / seen).alias("mean"),
        F.when(seen > 1, F.sqrt(F.greatest((sxx - sx * sx / seen) / (seen - 1), F.lit(0.0)))).alias("stddev"),
        F.min("x").alias("min_value"),
        F.max("x").alias("max_value"),
    )
    return out.withColumn("null_percentage", rate(F.col("null_count"), F.col("records")))


def window_volume(df: DataFrame, ts: str, granularity: str) -> DataFrame:
    """Rows and estimated bytes (text length of all columns) per window."""
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    return df.groupBy(F.date_trunc(granularity, F.col(ts)).alias("window_start")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(width).alias("bytes")
    )


def numeric_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    place = F.floor((x - lo) / (hi - lo) * bins)
    return F.when(x.isNull(), F.lit("null")).when(hi > lo, F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("string")).otherwise(F.lit("0"))


def js_terms(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    left = F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    right = F.when(q > 0, q * F.log2(q / m)).otherwise(F.lit(0.0))
    return (left + right) / 2


def histogram(df: DataFrame, numeric, categorical, bounds: Column | None, bins: int) -> DataFrame:
    """(column, bin, count) with numeric bins shared through ``bounds``."""
    rows = df if bounds is None else df.withColumn("_b", bounds)
    binned = [
        F.struct(F.lit(c).alias("column_name"), numeric_bin(F.col(c).cast("double"), F.col("_b")[c]["lo"], F.col("_b")[c]["hi"], bins).alias("bin"))
        for c in numeric
    ] + [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("bin")) for c in categorical]
    return rows.select(F.inline(F.array(*binned))).groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("c"))


def shared_bounds(frames, numeric) -> Column | None:
    """Scalar struct of the smallest and largest value per column over all frames."""
    if not numeric:
        return None
    parts = None
    for df in frames:
        one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max))])
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(
        *[F.struct(F.min(f"{c}_lo").alias("lo"), F.max(f"{c}_hi").alias("hi")).alias(c) for c in numeric]
    ).select(F.struct(*numeric)).scalar()


def drift(baseline: DataFrame, current: DataFrame, numeric=(), categorical=(), bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence (base 2) per column between two tables.

    Only histograms meet in the join; a column is two lists of bins.
    """
    bounds = shared_bounds([baseline, current], numeric)
    b = histogram(baseline, numeric, categorical, bounds, bins).withColumnRenamed("c", "cb")
    c = histogram(current, numeric, categorical, bounds, bins).withColumnRenamed("c", "cc")
    both = b.join(c, ["column_name", "bin"], "full_outer").select(
        "column_name", "bin", F.coalesce("cb", F.lit(0)).alias("cb"), F.coalesce("cc", F.lit(0)).alias("cc")
    )
    totals = both.groupBy("column_name").agg(F.sum("cb").alias("tb"), F.sum("cc").alias("tc"))
    js = F.sum(js_terms(F.col("cb") / F.col("tb"), F.col("cc") / F.col("tc")))
    out = both.join(totals, "column_name").groupBy("column_name").agg(F.greatest(js, F.lit(0.0)).alias("js_divergence"))
    return out.withColumn("drift_score", F.sqrt("js_divergence"))


def windowed_drift(df: DataFrame, ts: str, granularity: str, value: str, bins: int = 10) -> DataFrame:
    """Drift of each window against the window before it, one numeric column."""
    bounds = shared_bounds([df], [value])
    rows = df.withColumn("_b", bounds).select(
        F.date_trunc(granularity, F.col(ts)).alias("w"),
        numeric_bin(F.col(value).cast("double"), F.col("_b")[value]["lo"], F.col("_b")[value]["hi"], bins).alias("bin"),
    )
    h = rows.groupBy("w", "bin").agg(F.count(F.lit(1)).alias("c"))
    step = F.make_interval(days=F.lit(7 if granularity == "week" else 1))
    previous = h.select((F.col("w") + step).alias("w"), "bin", F.col("c").alias("p"))
    both = h.join(previous, ["w", "bin"], "full_outer").select(
        "w", "bin", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("p", F.lit(0)).alias("p")
    )
    totals = both.groupBy("w").agg(F.sum("c").alias("tc"), F.sum("p").alias("tp")).where("tc > 0 AND tp > 0")
    out = both.join(totals, "w").groupBy("w").agg(
        F.greatest(F.sum(js_terms(F.col("p") / F.col("tp"), F.col("c") / F.col("tc"))), F.lit(0.0)).alias("js_divergence")
    )
    return out.select(F.col("w").alias("window_start"), "js_divergence", F.sqrt("js_divergence").alias("drift_score"))


def drift_severity(score: Column) -> Column:
    return F.when(score > 0.5, F.lit("high")).when(score > 0.3, F.lit("medium")).otherwise(F.lit("low"))


def drift_alerts(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    return scores.where(F.col("drift_score") > threshold).withColumn("severity", drift_severity(F.col("drift_score")))


def monitor_summary(scores: DataFrame, nulls: DataFrame) -> DataFrame:
    """Columns, drift level and null level of one monitor run."""
    s = scores.agg(
        F.count(F.lit(1)).alias("columns"), F.avg("drift_score").alias("avg_drift"), F.max("drift_score").alias("max_drift"),
        F.count_if(F.col("drift_score") > 0.1).alias("drifted"), F.count_if(F.col("drift_score") > 0.5).alias("high_drift"),
    )
    return s.withColumn("avg_null_percentage", nulls.agg(F.avg("null_percentage")).scalar())
