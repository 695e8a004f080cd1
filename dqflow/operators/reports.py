"""Report tables: compliance, executive summary and detailed report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions import codes as C
from dqflow.operators import assess as A
from dqflow.operators.drift import drift_alerts, windowed_drift
from dqflow.operators.joins import eligible
from dqflow.operators.marts import history
from dqflow.operators.privacy import audit_complete
from dqflow.operators.profile import union_all
from dqflow.operators.skew import known
from dqflow.sources.tables import stored_layer

COMPLIANT = 95.0
TARGET = 95.0


def claim_checks() -> dict[str, Column]:
    """Compliance checks of a claim row carrying ``eligible`` and ``active`` flags."""
    return {
        "audit_trail": audit_complete("created_date", "claim_status"),
        "coding_accuracy": C.is_diagnosis_loose("diagnosis_code") & C.is_cpt_format("procedure_code"),
        "member_eligibility": F.col("eligible"),
        "provider_status": F.col("active"),
        "claim_amounts": C.is_claim_amount("claim_amount"),
    }


def claims_with_flags(claims: DataFrame, eligibility: DataFrame, providers: DataFrame) -> DataFrame:
    """Every claim as the outcomes of ``claim_checks``.

    What a claim tells by itself is settled before it travels, and the claims are stored in this form: only member, day
    and outcomes meet the eligibility of their member.
    """
    checks = claim_checks()
    own = [c.alias(k) for k, c in checks.items() if k not in ("member_eligibility", "provider_status")]
    rows = stored_layer(claims.select("member_id", "provider_npi", "date_of_service", *own), "compliance")
    rows = known(rows, providers.where("status = 'ACTIVE'"), "provider_npi", "provider_status")
    return eligible(rows.drop("provider_npi"), eligibility, name="member_eligibility", source=rows)


def compliance(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Score per check from the data and their mean, against the 95 percent mark."""
    n = F.count(F.lit(1))
    wide = df.agg(*[(F.count_if(c) / n * 100).alias(k) for k, c in checks.items()])
    mean = sum((F.col(k) for k in checks), F.lit(0.0)) / len(checks)
    rows = [F.struct(F.lit(k).alias("check_name"), F.col(k).alias("score")) for k in checks]
    rows.append(F.struct(F.lit("overall").alias("check_name"), mean.alias("score")))
    return wide.select(F.inline(F.array(*rows))).withColumn("compliant", F.col("score") >= COMPLIANT)


def executive_summary(summary: DataFrame) -> DataFrame:
    s = F.col("overall_score")
    return summary.select(
        "table_name", "overall_score", F.lit(TARGET).alias("target"),
        F.when(s >= 90, F.lit("good")).when(s >= 80, F.lit("warning")).otherwise(F.lit("critical")).alias("status"),
        "completeness", "validity", "critical_issues", F.col("record_count").alias("total_records"),
    )


def quality_trend(df: DataFrame, ts: str, fields, granularity: str = "month", target: float = TARGET) -> DataFrame:
    """The newest period's share of present fields beside the period before: one row.

    A row's score is the percentage of ``fields`` it carries; periods are averaged by ``history``, so the table is
    read once and only one row per period is ordered.
    """
    score = sum((C.present(f).cast("int") for f in fields), F.lit(0)) * F.lit(100) / F.lit(len(fields))
    periods = history(df.select(ts, score.alias("_quality_score")), ts, granularity)
    newest = periods.where("period IS NOT NULL").agg(
        F.max_by(F.struct("period", "records", "avg_score", "previous_score", "trend"), "period").alias("p"), F.count(F.lit(1)).alias("periods"))
    return newest.select("p.*", "periods", F.round(F.lit(target) - F.col("p.avg_score"), 6).alias("gap_to_target"))


def monitor_bundle(df: DataFrame, ts: str, value: str, since, granularity: str = "day", threshold: float = 0.05) -> DataFrame:
    """Everything a monitor page shows since a time, as (part, at, name, value).

    Parts: volume per window, profile of the value, drift against the window before, alerts, and a summary of these.
    The table is read once for volume and profile, once for drift; all later parts come from one row per window.
    """
    recent = F.col(ts) >= since
    x = F.col(value).cast("double")
    windows = stored_layer(df.where(recent).groupBy(F.date_trunc(granularity, F.col(ts)).alias("at")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("low"), F.max(x).alias("high")), "monitor")
    moved = stored_layer(windowed_drift(df, ts, granularity, value).where(F.col("window_start") >= since), "monitor-drift")
    raised = drift_alerts(moved, threshold)

    def part(rows, name, what, at, number):
        return rows.select(F.lit(name).alias("part"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"), F.lit(what).alias("name"), number.cast("double").alias("value"))

    def total(rows, what, number):
        return part(rows.agg(number.alias("_v")), "summary", what, F.lit(None).cast("timestamp"), F.col("_v"))

    parts = [part(windows, "metric", "records", F.col("at"), F.col("records"))]
    parts += [part(windows, "profile", what, F.col("at"), F.col(what)) for what in ("nulls", "low", "high")]
    parts += [part(moved, "drift", value, F.col("window_start"), F.col("js_divergence")), part(raised, "alert", value, F.col("window_start"), F.col("drift_score"))]
    parts += [total(windows, "windows", F.count(F.lit(1))), total(windows, "records", F.sum("records")),
              total(moved, "largest drift", F.max("js_divergence")), total(raised, "alerts", F.count(F.lit(1)))]
    return union_all(parts)


def detailed_report(results: DataFrame, findings: DataFrame | None = None, advice: bool = False) -> DataFrame:
    """Long table of dimensions, fields, failed rules and issues; also of findings by type and of advice where asked for."""

    def part(df, section, name, value):
        return df.select(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))

    out = (
        part(A.dimension_scores(results), "dimension", F.col("dimension"), F.col("score"))
        .unionByName(part(A.field_scores(results), "field", F.col("field"), F.col("field_score")))
        .unionByName(part(results.where("NOT passed"), "rule", F.concat_ws(".", "field", "rule"), F.col("score")))
        .unionByName(part(A.issues(results), "issue", F.col("type"), F.col("measured")))
    )
    if findings is not None:
        kinds = findings.groupBy("anomaly_type", "severity").agg(F.sum("affected_records").cast("double").alias("n"))
        out = out.unionByName(part(kinds, "anomaly", F.concat_ws(".", "anomaly_type", "severity"), F.col("n")))
    if advice:
        out = out.unionByName(part(A.recommendations(results), "recommendation", F.col("recommendation"), F.col("position").cast("double")))
    return out
