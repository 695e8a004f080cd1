"""Row-level scores and categories, in integer tenths to keep thresholds exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqflow.functions.scalars import is_true

SCORED_FIELDS = ("member_id", "provider_npi", "diagnosis_code", "procedure_code")


def _tenths(*parts) -> Column:
    total = F.lit(0)
    for condition, points in parts:
        total = total + F.when(is_true(condition), points).otherwise(0)
    return total


def quality_tenths(amount="claim_amount") -> Column:
    return _tenths(*[(F.col(c).isNotNull(), 2) for c in SCORED_FIELDS], (F.col(amount) > 0, 2))


def quality_score(amount="claim_amount") -> Column:
    return quality_tenths(amount) / F.lit(10.0)


def anomaly_score(amount="claim_amount") -> Column:
    a = F.col(amount)
    return (
        F.when(a > 50000, 0.9).when(a > 10000, 0.7).when(a > 5000, 0.5).when(a > 1000, 0.3).otherwise(0.1)
    )


def business_rule_score(quality="_quality_score", freshness="_data_freshness_hours", anomaly="_anomaly_score") -> Column:
    return _tenths((F.col(quality) >= 0.8, 4), (F.col(freshness) <= 24, 3), (F.col(anomaly) <= 0.5, 3)) / F.lit(10.0)


def risk_category(anomaly="_anomaly_score") -> Column:
    a = F.col(anomaly)
    return F.when(a > 0.7, F.lit("high_risk")).when(a > 0.4, F.lit("medium_risk")).otherwise(F.lit("low_risk"))


def utilization_category(claims) -> Column:
    return (
        F.when(claims > 20, F.lit("high_utilizer")).when(claims > 10, F.lit("moderate_utilizer"))
        .when(claims > 5, F.lit("regular_utilizer")).otherwise(F.lit("low_utilizer"))
    )


def cost_category(total) -> Column:
    return (
        F.when(total > 50000, F.lit("high_cost")).when(total > 20000, F.lit("moderate_cost"))
        .when(total > 5000, F.lit("regular_cost")).otherwise(F.lit("low_cost"))
    )


def quality_trend(avg_quality) -> Column:
    return (
        F.when(avg_quality >= 0.9, F.lit("excellent")).when(avg_quality >= 0.8, F.lit("good"))
        .when(avg_quality >= 0.7, F.lit("acceptable")).otherwise(F.lit("needs_attention"))
    )


def cost_of_poor_quality(fixes, score) -> Column:
    return F.lit(1000) + fixes * 50 * (1 - score / 100)
