"""Run health, failure analysis and retry policy over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dqflow.operators.timeline import trailing_in_slots

# Failure type, words, retryable, recovery action; first match wins.
FAILURE_TYPES = (
    ("resource_constraint", ("memory", "heap space"), True, "scale_up"),
    ("timeout", ("timeout", "deadline exceeded"), True, "retry_with_longer_timeout"),
    ("schema_drift", ("schema", "column"), False, "schema_adaptation"),
    ("data_quality", ("quality", "expectation"), False, "data_repair"),
)
# Failure category words in priority order.
CATEGORY_WORDS = (
    ("transient_network", ("connection", "timeout", "network", "unreachable", "socket", "dns", "ssl", "certificate", "handshake")),
    ("resource_constraint", ("memory", "heap", "out of memory", "disk space", "cpu", "resource", "quota", "limit exceeded", "capacity")),
    ("schema_drift", ("schema", "column", "field", "type mismatch", "parse error", "serialization", "deserialization", "json", "avro", "parquet")),
    ("data_quality", ("quality", "validation", "constraint", "expectation", "null", "duplicate", "invalid", "format", "range", "integrity")),
    ("configuration", ("config", "permission", "access", "credential", "authentication", "authorization", "key", "token", "missing parameter")),
)
PERMANENT_WORDS = (
    "file not found", "table does not exist", "invalid credentials", "access denied", "syntax error", "illegal argument",
)
# Retries, base and maximum delay in seconds, strategy, multiplier.
RETRY_POLICY = {
    "transient_network": (5, 30, 300, "exponential", 2.0),
    "resource_constraint": (3, 120, 1800, "exponential", 1.5),
    "schema_drift": (1, 300, 300, "fixed", 2.0),
    "data_quality": (2, 180, 900, "linear", 2.0),
    "configuration": (1, 60, 60, "fixed", 2.0),
    "unknown": (3, 90, 720, "adaptive", 2.0),
}


def contains_any(text: Column, words) -> Column:
    return text.rlike("|".join(w.replace(".", r"\.") for w in words))


def failure_type(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.struct(
        F.lit("unknown").alias("type"), F.lit(True).alias("can_retry"), F.lit("simple_retry").alias("recovery_action")
    )
    for name, words, retry, action in reversed(FAILURE_TYPES):
        found = F.struct(F.lit(name).alias("type"), F.lit(retry).alias("can_retry"), F.lit(action).alias("recovery_action"))
        out = F.when(contains_any(text, words), found).otherwise(out)
    return out


def failure_category(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(CATEGORY_WORDS):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def is_permanent(message: Column) -> Column:
    return contains_any(F.lower(F.coalesce(message, F.lit(""))), PERMANENT_WORDS)


def policy(category: Column) -> Column:
    names = ("max_retries", "base_delay", "max_delay", "strategy", "multiplier")
    return F.create_map(
        *[x for c, p in RETRY_POLICY.items() for x in (F.lit(c), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p)]))]
    )[category]


def retry_plan(failures: DataFrame, ts="started_at", message="error_message", retries="retry_count") -> DataFrame:
    """Category, whether to retry and the delay before it, jitter left out.

    Recent failures of the category are counted exactly over one and two hours
    with windows that hold two window widths of one category at most.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = failures.withColumn("category", failure_category(F.col(message)))
    rows = trailing_in_slots(rows, "category", at, 3600, "failures_1h")
    rows = trailing_in_slots(rows, "category", at, 7200, "failures_2h")
    p, n = policy(F.col("category")), F.col(retries)
    repeated = F.col("failures_1h") >= 3
    after_repeat = (
        F.when(F.col("category").isin("schema_drift", "configuration"), F.lit(False))
        .when(F.col("category") == "resource_constraint", n < 2)
        .otherwise(F.lit(True))
    )
    should = (n < p["max_retries"]) & ~is_permanent(F.col(message)) & (~repeated | after_repeat)
    growth = F.pow(p["multiplier"], n)
    adaptive = F.floor(
        p["base_delay"] * F.when(F.col("failures_2h") > 5, F.lit(1.5) + (F.col("failures_2h") - 5) * F.lit(0.2)).otherwise(growth)
    )
    delay = (
        F.when(p["strategy"] == "exponential", p["base_delay"] * growth)
        .when(p["strategy"] == "linear", (p["base_delay"] * (1 + n)).cast("double"))
        .when(p["strategy"] == "fixed", p["base_delay"].cast("double"))
        .otherwise(adaptive.cast("double"))
    )
    capped = F.floor(F.greatest(F.lit(1.0), F.least(delay, p["max_delay"].cast("double"))))
    return rows.withColumns({"should_retry": should, "delay_seconds": capped.cast("bigint")})


def backoff(retries: Column) -> Column:
    """Seconds before the next simple retry, none after three."""
    return F.when(retries < 3, F.least(F.lit(300.0), F.lit(60.0) * F.pow(F.lit(2.0), retries)))


def since(runs: DataFrame, as_of, days: int) -> DataFrame:
    return runs.where(F.col("started_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def newest_failures(runs: DataFrame, key="pipeline_id", k: int = 5) -> DataFrame:
    """The newest ``k`` failed runs per key; ``job_health`` has their true number.

    The rank filter keeps ``k`` rows per key and task before the shuffle.
    """
    newest = W.partitionBy(key).orderBy(F.desc("started_at"), F.desc("event_id"))
    ranked = runs.where("status = 'FAILED'").withColumn("position", F.row_number().over(newest)).where(F.col("position") <= k)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "run_id"))), lambda r: r["run_id"]).alias("newest_failures"))


def job_health(runs: DataFrame, key="pipeline_id") -> DataFrame:
    """Totals per key; pass runs through ``since`` for the last days only."""
    n = F.count(F.lit(1))
    failed = F.col("status") == "FAILED"
    order = F.struct("started_at", "event_id")
    return runs.groupBy(key).agg(
        n.alias("total_runs"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful_runs"),
        F.count_if(failed).alias("failed_runs"),
        (F.count_if(F.col("status") == "SUCCESS") / n * 100).alias("success_rate"),
        (F.sum("execution_time_seconds").cast("double") / n / 60).alias("average_duration_minutes"),
        F.count_if(failed).alias("recent_failures"),
        F.max_by("status", order).alias("last_run_status"),
    )


def recent_retries(runs: DataFrame, as_of, hours: int = 1, key="pipeline_id") -> DataFrame:
    recent = (F.col("started_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))) & (F.col("retry_count") > 0)
    n = F.count_if(recent)
    return runs.groupBy(key).agg(n.alias("retries")).withColumn("backoff_seconds", backoff(F.col("retries")))


def failure_statistics(failures: DataFrame, message="error_message") -> DataFrame:
    """Counts per category folded into one row with the commonest category."""
    per = failures.withColumn("category", failure_category(F.col(message))).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("r"), F.sum("retry_count").alias("t")
    )
    return per.agg(
        F.sum("n").alias("total_failures"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"),
        F.round(F.sum("r") / F.sum("n") * 100, 1).alias("resolution_rate"),
        F.max_by("category", F.struct("n", "category")).alias("most_common_category"),
        F.round(F.sum("t") / F.sum("n"), 1).alias("avg_retries_per_failure"),
    )


def retry_advice(stats: DataFrame) -> DataFrame:
    def item(kind, priority, action):
        return F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(action).alias("action"))

    cases = [
        F.when(F.col("resolution_rate") < 70, item("resolution_rate", "high", "Read the failures that were never resolved and handle their causes")),
        F.when(
            F.col("most_common_category") == "resource_constraint",
            item("resource_scaling", "medium", "Give these pipelines more memory or let their clusters grow"),
        ),
        F.when(F.col("avg_retries_per_failure") > 2, item("retry_optimization", "medium", "Retry fewer times, or wait longer between attempts")),
    ]
    return stats.select(F.inline(F.array_compact(F.array(*cases))))


def run_health_score(state: Column, last_status: Column) -> Column:
    return F.greatest(
        F.lit(0),
        F.lit(100) - F.when(state == "FAILED", 50).otherwise(0)
        - F.when(last_status == "FAILED", 30).when(last_status == "CANCELLED", 20).otherwise(0),
    )


def health_label(score: Column) -> Column:
    return F.when(score >= 85, F.lit("healthy")).when(score >= 70, F.lit("warning")).otherwise(F.lit("critical"))


def run_statistics(runs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return runs.groupBy("tenant_id", "pipeline_id").agg(
        n.alias("runs"),
        (F.count_if(F.col("status") == "SUCCESS") / n * 100).alias("success_rate"),
        (F.sum("execution_time_seconds").cast("double") / n).alias("mean_runtime_seconds"),
        F.sum("gb_processed").alias("gb_processed"),
    )


def tenant_rollup(runs: DataFrame, limits: Column) -> DataFrame:
    """Per-tenant activity; ``limits`` gives the plan's GB allowance per row."""
    pairs = runs.groupBy("tenant_id", "pipeline_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.sum("gb_processed").alias("gb")
    )
    t = pairs.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("active_pipelines"), F.sum("n").alias("runs"), F.sum("ok").alias("ok"), F.sum("gb").alias("gb_processed")
    )
    return t.withColumn("success_rate", F.col("ok") / F.col("runs") * 100).withColumn(
        "utilisation_percentage", F.col("gb_processed").cast("double") / limits * 100
    ).drop("ok")


def platform_rollup(tenants: DataFrame) -> DataFrame:
    return tenants.agg(
        F.count(F.lit(1)).alias("tenants"), F.sum("active_pipelines").alias("active_pipelines"), F.sum("runs").alias("runs"),
        F.sum("gb_processed").alias("gb_processed"),
        (F.sum("gb_processed").cast("double") / F.count(F.lit(1))).alias("gb_per_tenant"),
    )
