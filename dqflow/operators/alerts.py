"""Alert rules, suppression, lifecycle and component health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.operators.skew import attach_stats
from dqflow.operators.timeline import even_slot, lag_in_slots, last_before_in_slots, sequence_in_slots

# Threshold rules on metric points.
METRIC_RULES = (
    ("high_usage_warning", "tenant_usage_percentage", ">", 80.0, "warning"),
    ("usage_limit_critical", "tenant_usage_percentage", ">", 95.0, "critical"),
    ("pipeline_failure_rate", "pipeline_failure_rate", ">", 20.0, "error"),
    ("api_response_time", "api_response_time", ">", 2000.0, "warning"),
)
# Operations rules.
OPERATIONS_RULES = (
    ("low_data_quality", "quality_score", "<", 80.0, "warning"),
    ("critical_data_quality", "quality_score", "<", 60.0, "critical"),
    ("run_failure", "success_rate", "<", 95.0, "warning"),
    ("high_compute_cost", "hourly_cost", ">", 50.0, "warning"),
)
# Table alert thresholds.
TABLE_THRESHOLDS = {"min_quality_score": 0.7, "max_anomaly_percentage": 5.0, "max_stale_percentage": 10.0}
QUIET = (22, 6)


def rule_rows(rules) -> Column:
    return F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(m).alias("metric"), F.lit(o).alias("operator"), F.lit(t).alias("limit"), F.lit(s).alias("severity"))
            for n, m, o, t, s in rules
        ]
    )


def check_rules(metrics: DataFrame, rules=METRIC_RULES) -> DataFrame:
    """One alert per metric point and violated rule.

    The rules are constants in the row expression: each point meets only the
    rules of its own metric, without a join.
    """
    points = metrics.where(F.col("metric_name").isin(*sorted({r[1] for r in rules})))
    hit = points.select("*", F.inline(F.filter(rule_rows(rules), lambda r: r["metric"] == F.col("metric_name"))))
    v, t, op = F.col("value"), F.col("limit"), F.col("operator")
    return hit.where(((op == ">") & (v > t)) | ((op == "<") & (v < t)) | ((op == "=") & (v == t))).drop("metric")


def table_alerts(metrics: DataFrame, thresholds=None) -> DataFrame:
    """Alerts on one row of table metrics."""
    t = {**TABLE_THRESHOLDS, **(thresholds or {})}
    cases = [
        ("low_quality_score", "high", F.col("avg_quality_score"), F.col("avg_quality_score") < t["min_quality_score"], t["min_quality_score"]),
        ("high_anomaly_rate", "medium", F.col("high_anomaly_percentage"), F.col("high_anomaly_percentage") > t["max_anomaly_percentage"], t["max_anomaly_percentage"]),
        ("stale_data", "medium", F.col("stale_percentage"), F.col("stale_percentage") > t["max_stale_percentage"], t["max_stale_percentage"]),
    ]
    rows = [
        F.when(cond, F.struct(F.lit(n).alias("alert_type"), F.lit(s).alias("severity"), v.cast("double").alias("measured"), F.lit(float(x)).alias("threshold")))
        for n, s, v, cond, x in cases
    ]
    return metrics.select(F.inline(F.array_compact(F.array(*rows))))


def assessment_alert(overall: Column, critical_issues: Column) -> Column:
    return (
        F.when((overall < 60) | (critical_issues > 0), F.lit("critical")).when(overall < 80, F.lit("warning")).otherwise(F.lit("none"))
    )


# Alert conditions over one row of table measures.
CONDITION_SETS = {
    "critical": ("overall_quality_score < 0.60", "completeness_score < 0.70", "validity_score < 0.75", "critical_violations > 0"),
    "warning": ("overall_quality_score < 0.80", "completeness_score < 0.85", "data_age_hours > 24", "anomaly_count > 100"),
    "info": ("previous_quality_score > overall_quality_score",),
}


def condition_alerts(row: DataFrame, sets=None) -> DataFrame:
    cases = [
        F.struct(F.lit(level).alias("severity"), F.lit(text).alias("condition"), F.expr(text).alias("hit"))
        for level, texts in (CONDITION_SETS if sets is None else sets).items()
        for text in texts
    ]
    return row.select(F.inline(F.array(*cases))).where("hit").drop("hit")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def suppress(alerts: DataFrame, keys, ts: str, order: list, minutes: int = 60) -> DataFrame:
    """Mark repeats within the window of the same alert, and quiet hours."""
    out = lag_in_slots(alerts, keys, ts, even_slot(alerts, keys, _micros(ts)), order, ts, "_previous")
    gap = F.col(ts) - F.col("_previous")
    hour = F.hour(ts)
    return out.withColumns(
        {
            "suppressed": F.coalesce(gap <= F.make_dt_interval(mins=F.lit(minutes)), F.lit(False)),
            "quiet_hours": (hour >= QUIET[0]) | (hour < QUIET[1]),
        }
    ).drop("_previous")


def lifecycle(events: DataFrame) -> DataFrame:
    """Current state per alert from its trigger, acknowledge and resolve events.

    Events before the first trigger, acknowledgements after the resolution and
    anything after it are illegal and ignored.
    """
    at = F.struct("timestamp", "event_id")
    rows = attach_stats(
        events, "alert_id", [F.min(F.when(F.col("action") == "trigger", at)).alias("_t0")]
    ).where("_t0 IS NOT NULL")
    later = at > F.col("_t0")
    state = rows.groupBy("alert_id", "tenant_id", "severity", "component").agg(
        F.min("_t0").alias("_t0"),
        F.min(F.when((F.col("action") == "acknowledge") & later, at)).alias("_ack"),
        F.min(F.when((F.col("action") == "resolve") & later, at)).alias("_res"),
    )
    ack = F.when(F.col("_res").isNull() | (F.col("_ack") < F.col("_res")), F.col("_ack"))
    return state.withColumn("_ack", ack).select(
        "alert_id", "tenant_id", "severity", "component",
        F.when(F.col("_res").isNotNull(), F.lit("resolved")).when(F.col("_ack").isNotNull(), F.lit("acknowledged"))
        .otherwise(F.lit("triggered")).alias("status"),
        F.col("_t0.timestamp").alias("triggered_at"),
        F.col("_ack.timestamp").alias("acknowledged_at"),
        F.col("_res.timestamp").alias("resolved_at"),
    )


def active(state: DataFrame, tenant=None, severity=None) -> DataFrame:
    out = state.where(F.col("status").isin("triggered", "acknowledged"))
    if tenant:
        out = out.where(F.col("tenant_id") == tenant)
    if severity:
        out = out.where(F.col("severity") == severity)
    return out.orderBy(F.desc("triggered_at"), "alert_id")


def health_status(warning: float, error: float) -> Column:
    r = F.col("response_time")
    return (
        F.when(r > error, F.lit("unhealthy")).when(r > warning, F.lit("degraded")).when(F.col("error"), F.lit("unhealthy"))
        .otherwise(F.lit("healthy"))
    )


def health_history(checks: DataFrame, warning: float = 1000.0, error: float = 5000.0) -> DataFrame:
    """Status per check, the status before it and the run of failures ending there."""
    slot, order = even_slot(checks, "component", _micros("timestamp")), ["timestamp", "event_id"]
    rows = checks.withColumn("status", health_status(warning, error))
    rows = lag_in_slots(rows, "component", "timestamp", slot, order, "status", "previous_status")
    rows = sequence_in_slots(rows, "component", slot, order, "_seq")
    rows = last_before_in_slots(
        rows, "component", slot, order, F.when(F.col("status") == "healthy", F.col("_seq")), "_last_ok"
    )
    run = F.when(F.col("status") == "healthy", F.lit(0)).otherwise(F.col("_seq") - F.coalesce("_last_ok", F.lit(0)))
    return rows.withColumn("consecutive_failures", run).drop("_seq", "_last_ok")


def health_alerts(history: DataFrame) -> DataFrame:
    """Alerts for changes to a worse status, resolutions for a return to healthy."""
    changed = history.where(F.coalesce("previous_status", F.lit("unknown")) != F.col("status"))
    kind = (
        F.when(F.col("status") == "unhealthy", F.lit("error")).when(F.col("status") == "degraded", F.lit("warning"))
        .when(F.col("previous_status").isNotNull(), F.lit("resolve"))
    )
    return changed.withColumn("alert", kind).where("alert IS NOT NULL")


def next_recovery(alerts: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Time of the component's next recovery after each alert, for automatic resolution.

    Walks backwards in time: the last recovery before a row in descending order
    is the next one in time.
    """
    a = alerts.select("alert_id", "component", F.col("triggered_at").alias("at"), F.lit(False).alias("recovery"))
    r = recoveries.select(F.lit(None).cast("string").alias("alert_id"), "component", F.col("timestamp").alias("at"), F.lit(True).alias("recovery"))
    both = a.unionByName(r).withColumn("_back", -F.unix_micros(F.col("at").cast("timestamp")))
    both = both.withColumn("_flag", F.col("recovery").cast("int"))
    out = last_before_in_slots(
        both, "component", even_slot(both, "component", F.col("_back")), ["_back", "_flag"],
        F.when(F.col("recovery"), F.col("at")), "resolved_at",
    )
    return out.where("NOT recovery").select("alert_id", "component", F.col("at").alias("triggered_at"), "resolved_at")


def overall_status(health: DataFrame, active_alerts: DataFrame) -> DataFrame:
    """One row: worst state over component health and open alerts."""
    h = health.agg(
        F.count_if(F.col("status") == "healthy").alias("healthy"), F.count_if(F.col("status") == "degraded").alias("degraded"),
        F.count_if(F.col("status") == "unhealthy").alias("unhealthy"),
    )
    levels = ("critical", "error", "warning", "info")
    a = active_alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])
    out = h.withColumns({s: a.select(s).scalar() for s in levels})
    status = (
        F.when(F.col("critical") > 0, F.lit("unhealthy"))
        .when((F.col("error") > 0) | (F.col("unhealthy") > 0) | (F.col("warning") > 0) | (F.col("degraded") > 0), F.lit("degraded"))
        .otherwise(F.lit("healthy"))
    )
    return out.withColumn("overall_status", status)


def metrics_summary(metrics: DataFrame, since) -> DataFrame:
    recent = metrics.where(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz"))
    return recent.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        (F.sum("value").cast("double") / F.count(F.lit(1))).alias("avg_value"),
        F.max_by("value", F.struct("timestamp", "event_id")).alias("latest"),
    )


def burst_alerts(events: DataFrame, ts: str, minutes: int = 5, limit: int = 10) -> DataFrame:
    """Windows with more events than allowed."""
    w = F.window(F.col(ts), f"{minutes} minutes")
    return events.groupBy(w).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(F.col("window.start").alias("window_start"), "n")
