"""Look-ups, existence rules, duplicates and comparisons with group statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.functions.scalars import is_true
from dqflow.operators.quantiles import exact_percentiles, histogram, histogram_percentiles
from dqflow.operators.skew import attach_stats, first_per_key, flag_member, join_unique, look_up
from dqflow.operators.timeline import (
    flag_covered,
    flag_covered_by,
    flag_earlier_within,
    flag_not_first,
    trailing_count,
    trailing_distinct,
)

OPEN_END = dt.date(2099, 12, 31)
DUPLICATE_KEY = ["member_id", "provider_npi", "date_of_service", "procedure_code"]


def eligible(claims: DataFrame, eligibility: DataFrame, active_only=False, name="eligible", **kw) -> DataFrame:
    spans = eligibility.where("status = 'ACTIVE'") if active_only else eligibility
    return flag_covered(claims, spans, "member_id", "date_of_service", "start_date", "end_date", OPEN_END, name, **kw)


def eligible_and_active(claims: DataFrame, eligibility: DataFrame, **kw) -> DataFrame:
    """Eligibility by all spans and by the active ones alone, with one look-up of the member."""
    named = {"eligible": eligibility, "eligible_active": eligibility.where("status = 'ACTIVE'")}
    return flag_covered_by(claims, named, "member_id", "date_of_service", "start_date", "end_date", OPEN_END, **kw)


def provider_active(claims: DataFrame, providers: DataFrame, name="provider_active", **kw) -> DataFrame:
    """Active provider without a termination on or before the service date.

    Each provider folds to the last day it is active, so one row per provider
    answers the existence question.
    """
    until = providers.where("status = 'ACTIVE'").groupBy("provider_npi").agg(
        F.max(F.coalesce("termination_date", F.lit(dt.date(9999, 12, 31)))).alias("_until")
    )
    out = join_unique(claims, until, "provider_npi", **kw)
    open_ended = F.col("_until") == F.lit(dt.date(9999, 12, 31))
    return out.withColumn(name, is_true(open_ended | (F.col("_until") > F.col("date_of_service")))).drop("_until")


def in_network(claims: DataFrame, network: DataFrame, name="in_network", **kw) -> DataFrame:
    spans = network.where("network_status = 'PARTICIPATING'")
    return flag_covered(
        claims, spans, "provider_npi", "date_of_service", "contract_start_date", "contract_end_date", OPEN_END, name, **kw
    )


def prior_auth_ok(claims: DataFrame, high_cost: DataFrame, auths: DataFrame) -> DataFrame:
    """Required for costly listed procedures at facility places of service."""
    listed = high_cost.select(F.col("code").alias("procedure_code"))
    rows = flag_member(claims, listed, "procedure_code", "_listed")
    required = (F.col("claim_amount") > 1000) & F.col("_listed") & F.col("place_of_service").isin("21", "22", "23")
    rows = flag_covered(
        rows.withColumn("auth_required", is_true(required)), auths.where("status = 'APPROVED'"),
        ["member_id", "procedure_code"], "date_of_service", "auth_start_date", "auth_end_date", OPEN_END, "_authorised",
        source=claims,
    )
    return rows.withColumn("auth_ok", ~F.col("auth_required") | F.col("_authorised")).drop("_listed", "_authorised")


def duplicate_flag(claims: DataFrame, at="created_date", name="duplicate", strict=False) -> DataFrame:
    """A claim repeated on the duplicate key after an earlier one.

    ``strict`` compares times only, so claims of the same time all survive;
    otherwise the claim id breaks the tie and one survives.
    """
    return flag_not_first(claims, DUPLICATE_KEY, [at] if strict else [at, "claim_id"], name)


def drop_duplicates(claims: DataFrame, at="created_date") -> DataFrame:
    """One claim per duplicate key; claims with an incomplete key are all kept."""
    complete = F.lit(True)
    for k in DUPLICATE_KEY:
        complete = complete & F.col(k).isNotNull()
    best = first_per_key(claims.where(complete), DUPLICATE_KEY, [at, "claim_id"])
    return best.unionByName(claims.where(~complete))


def recent_duplicate(claims: DataFrame, days: int = 30, name="duplicate") -> DataFrame:
    """Another paid or open claim on the wider key submitted in the days before."""
    live = ~F.col("claim_status").isin("DENIED", "VOIDED")
    return flag_earlier_within(
        claims, [*DUPLICATE_KEY, "diagnosis_code"], "submission_date", days, name, counts=live, ident="claim_id", coarse="date_of_service"
    )


def orphans(claims: DataFrame, reference: DataFrame, key: str, name="exists", **kw) -> DataFrame:
    return flag_member(claims, reference, key, name, **kw)


def over_group_sigma(claims: DataFrame, by="procedure_code", value="claim_amount", sigmas=3.0, min_rows=1) -> DataFrame:
    """Flag values above the group's mean plus a number of standard deviations."""
    x = F.col(value).cast("double")
    rows = attach_stats(
        claims, by,
        [F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"), F.count(F.col(value)).alias("_cnt")], few=True,
    )
    high = (F.col("_cnt") >= min_rows) & (F.col("_sd") > 0) & (x > F.col("_mean") + sigmas * F.col("_sd"))
    return rows.withColumn("over_limit", is_true(high)).drop("_mean", "_sd", "_cnt")


def over_percentile(claims: DataFrame, p=0.99, by=None, value="claim_amount", name="over_p99") -> DataFrame:
    """Flag values above the exact percentile, of the table or of their group."""
    if by is None:
        limit = exact_percentiles(claims, [], value, {"_p": p}).select("_p").scalar()
        return claims.withColumn(name, is_true(F.col(value) > limit))
    limits = exact_percentiles(claims, by, value, {"_p": p}).drop("_n")
    out = look_up(claims, limits, by)
    return out.withColumn(name, is_true(F.col(value) > F.col("_p"))).drop("_p")


def over_both_percentiles(claims: DataFrame, p=0.99, by="procedure_code", value="claim_amount", name="over_p99", group_name="over_group_p99") -> DataFrame:
    """``over_percentile`` of the table and of the group, both from one histogram of the groups."""
    hist = histogram(claims, by, value)
    whole = exact_percentiles(hist, [], "_v", {"_p": p}, weight="_c").select("_p").scalar()
    out = look_up(claims, histogram_percentiles(hist, by, {"_p": p}).drop("_n"), by)
    return out.withColumns({name: is_true(F.col(value) > whole), group_name: is_true(F.col(value) > F.col("_p"))}).drop("_p")


def billing_spike(claims: DataFrame, key="provider_npi", day="date_of_service", factor=3.0) -> DataFrame:
    """Days on which the trailing week exceeds a multiple of the mean weekly count."""
    weekly = claims.where(F.col(day).isNotNull()).groupBy(key, F.date_trunc("week", day).alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    mean = weekly.groupBy(key).agg((F.sum("_n") / F.count(F.lit(1))).alias("avg_weekly"))
    trailing = trailing_count(claims.where(F.col(day).isNotNull()), key, day, 6, "trailing_7d")
    return join_unique(trailing, mean, key).withColumn("spike", F.col("trailing_7d") > F.col("avg_weekly") * factor)


def review_flag(claims: DataFrame, approved: DataFrame) -> DataFrame:
    """High amounts whose procedure is not pre-approved; NULL procedures are reviewed."""
    listed = approved.select(F.col("code").alias("procedure_code"))
    rows = flag_member(claims, listed, "procedure_code", "_approved")
    return rows.withColumn("flag_for_review", is_true(F.col("claim_amount") > 10000) & ~F.col("_approved")).drop("_approved")


def utilization_windows(claims: DataFrame, days: int = 30) -> DataFrame:
    """Trailing claim and provider counts per member and active day."""
    rows = claims.where("member_id IS NOT NULL AND date_of_service IS NOT NULL")
    n = trailing_count(rows, "member_id", "date_of_service", days, "claims_30d")
    p = trailing_distinct(rows, "member_id", "date_of_service", "provider_npi", days, "providers_30d")
    return n.join(p, ["member_id", "date_of_service"])


def enrich(claims: DataFrame, lookups, **kw) -> DataFrame:
    """Left look-ups ``[(reference, key), ...]``, each reduced to one row per key."""
    out = claims
    for reference, key in lookups:
        rest = [c for c in reference.columns if c != key]
        out = join_unique(out, first_per_key(reference, key, rest[:1]), key, source=claims, **kw)
    return out


def eligibility_lookup(requests: DataFrame, eligibility: DataFrame, network: DataFrame) -> DataFrame:
    """Batch answer for member, day and provider: coverage and network status."""
    spans = eligibility.groupBy("member_id").agg(F.min("start_date").alias("first_start"), F.max(F.coalesce("end_date", F.lit(OPEN_END))).alias("last_end"))
    rows = flag_covered_by(requests, {"eligible": eligibility}, "member_id", "date_of_service", "start_date", "end_date", OPEN_END, spans)
    out = in_network(rows, network, source=requests)
    status = (
        F.when(F.col("first_start").isNull(), F.lit("UNKNOWN_MEMBER")).when(F.col("eligible"), F.lit("ELIGIBLE")).otherwise(F.lit("NOT_ELIGIBLE"))
    )
    return out.withColumn("status", status)
