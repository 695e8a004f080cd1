"""Column profiles: one wide aggregate, one unpivoted value count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow.operators.assess import one_pass
from dqflow.operators.quantiles import exact_percentiles

# Text patterns counted per string column.
PATTERNS = {
    "email": r"^[^@]+@[^@]+\.[^@]+$",
    "phone": r"^[0-9()+\s-]+$",
    "numeric": r"^[0-9]+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
}


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def numeric_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_fields(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_stats(df: DataFrame, fields=None) -> DataFrame:
    """One row per column: null count and, for numbers, min, max, mean, stddev."""
    fields = fields or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    m = {}
    for f in fields:
        m[f"{f}\x1fnulls"] = F.count_if(F.col(f).isNull())
        if is_numeric(types[f]):
            x = F.col(f).cast("double")
            m[f"{f}\x1fmin"], m[f"{f}\x1fmax"] = F.min(x), F.max(x)
            m[f"{f}\x1fmean"], m[f"{f}\x1fstddev"] = F.avg(x), F.stddev_samp(x)
    raw = one_pass(df, m)
    parts = F.split("key", "\x1f")
    wide = (
        raw.select(parts[0].alias("field"), parts[1].alias("stat"), "value", "total")
        .groupBy("field", "total")
        .pivot("stat", ["nulls", "min", "max", "mean", "stddev"])
        .agg(F.first("value"))
    )
    return wide.select(
        "field",
        F.col("total").cast("bigint").alias("total_count"),
        F.col("nulls").cast("bigint").alias("null_count"),
        F.when(F.col("total") > 0, F.col("nulls") / F.col("total") * 100).otherwise(F.lit(0.0)).alias("null_percentage"),
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
        F.col("mean").alias("mean_value"),
        F.col("stddev").alias("stddev_value"),
    )


def value_counts(df: DataFrame, fields) -> DataFrame:
    """``(field, value, n)``; the value is part of the shuffle key."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent values per field, ties by value.

    The rank filter is applied per task before the shuffle, so a field with
    many values sends only ``k`` rows per task to its reducer.
    """
    w = W.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return counts.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def medians(df: DataFrame, fields) -> DataFrame:
    """Exact median per numeric column, all columns in one histogram."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])
    return exact_percentiles(df.select(F.inline(pairs)), "field", "x", {"median_value": 0.5}).drop("_n")


def profile(df: DataFrame, fields=None) -> DataFrame:
    """Full profile, one row per column."""
    fields = list(fields or df.columns)
    counts = value_counts(df, fields)
    distinct = counts.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_count"))
    top = top_values(counts).groupBy("field").agg(
        F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("top_values")
    )
    # Left joins: a table without rows still has its columns.
    out = column_stats(df, fields).join(distinct, "field", "left").join(top, "field", "left")
    out = out.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    out = out.withColumn(
        "uniqueness_percentage",
        F.when(F.col("total_count") > 0, F.col("distinct_count") / F.col("total_count") * 100).otherwise(F.lit(0.0)),
    )
    numbers = [f for f in fields if f in numeric_fields(df)]
    if numbers:
        out = out.join(medians(df, numbers), "field", "left")
    texts = [f for f in fields if f in string_fields(df)]
    if texts:
        pats = patterns(df, texts).select(
            "field",
            F.create_map(*[x for p in (*PATTERNS, "uppercase", "lowercase") for x in (F.lit(p), F.col(p))]).alias("patterns"),
        )
        out = out.join(pats, "field", "left")
    return out


def patterns(df: DataFrame, fields=None) -> DataFrame:
    """Length range and pattern counts per string column, over all values.

    Empty strings are left out, like NULLs.
    """
    fields = fields or string_fields(df)
    m = {}
    for f in fields:
        c = F.when(F.col(f) != "", F.col(f))
        n = F.length(c)
        m[f"{f}\x1fvalues"] = F.count(c)
        m[f"{f}\x1fmin_length"], m[f"{f}\x1fmax_length"], m[f"{f}\x1favg_length"] = F.min(n), F.max(n), F.avg(n)
        m[f"{f}\x1femail"] = F.count_if(c.rlike(PATTERNS["email"]))
        m[f"{f}\x1fphone"] = F.count_if(c.rlike(PATTERNS["phone"]) & (F.length(F.regexp_replace(c, "[^0-9]", "")) >= 10))
        m[f"{f}\x1fnumeric"] = F.count_if(F.regexp_replace(c, "[.-]", "").rlike(PATTERNS["numeric"]))
        m[f"{f}\x1falphanumeric"] = F.count_if(F.replace(c, F.lit(" "), F.lit("")).rlike(PATTERNS["alphanumeric"]))
        m[f"{f}\x1fuppercase"] = F.count_if((F.upper(c) == c) & (F.lower(c) != c))
        m[f"{f}\x1flowercase"] = F.count_if((F.lower(c) == c) & (F.upper(c) != c))
    raw = one_pass(df, m)
    parts = F.split("key", "\x1f")
    counts = ["values", *PATTERNS, "uppercase", "lowercase"]
    wide = (
        raw.select(parts[0].alias("field"), parts[1].alias("stat"), "value")
        .groupBy("field")
        .pivot("stat", [*counts, "min_length", "max_length", "avg_length"])
        .agg(F.first("value"))
    )
    return wide.select(
        "field",
        *[F.col(c).cast("bigint").alias(c) for c in counts],
        F.coalesce(F.col("min_length"), F.lit(0)).cast("bigint").alias("min_length"),
        F.coalesce(F.col("max_length"), F.lit(0)).cast("bigint").alias("max_length"),
        F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"),
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
