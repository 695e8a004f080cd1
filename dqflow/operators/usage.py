"""Usage rollups, plans, invoices and billing periods, all in decimals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqflow.operators.skew import join_unique

METRICS = ("gb_processed", "compute_hours", "storage_gb", "quality_checks")
# Price per unit.
PRICES = {
    "gb_processed": Decimal("0.10"), "compute_hours": Decimal("2.50"), "storage_gb": Decimal("0.05"), "quality_checks": Decimal("0.001"),
}
# Plan, monthly fee, included usage and overage rate per metric.
PLANS = {
    "starter": ("99.00", (100, 50, 500, 10000), ("0.10", "2.50", "0.05", "0.001")),
    "professional": ("299.00", (1000, 200, 2000, 50000), ("0.08", "2.00", "0.04", "0.0008")),
    "enterprise": ("999.00", (10000, 1000, 10000, 250000), ("0.06", "1.50", "0.03", "0.0006")),
    "healthcare_plus": ("1999.00", (50000, 5000, 50000, 1000000), ("0.05", "1.25", "0.025", "0.0005")),
}
TAX = Decimal("0.08")
ANNUAL = Decimal("10.8")  # twelve months less ten percent


def _map(values: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def price(metric="event_type") -> Column:
    return _map(PRICES, "decimal(10,4)")[F.col(metric)]


def plan_rows() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("plan_id"), F.lit(Decimal(fee)).cast("decimal(12,2)").alias("base_monthly_fee"), F.lit(m).alias("metric"),
                F.lit(inc).cast("bigint").alias("included"), F.lit(Decimal(r)).cast("decimal(10,4)").alias("overage_rate"),
            )
            for p, (fee, incs, rates) in PLANS.items()
            for m, inc, r in zip(METRICS, incs, rates)
        ]
    )


def plan_fee(plan="plan_id") -> Column:
    return _map({p: Decimal(v[0]) for p, v in PLANS.items()}, "decimal(12,2)")[F.col(plan)]


def _by_plan(index: int, kind: str, plan: str, metric: str) -> Column:
    flat = {f"{p}/{m}": (Decimal(x) if isinstance(x, str) else x) for p, v in PLANS.items() for m, x in zip(METRICS, v[index])}
    return _map(flat, kind)[F.concat_ws("/", F.col(plan), F.col(metric))]


def included(plan="plan_id", metric="event_type") -> Column:
    return _by_plan(1, "decimal(18,6)", plan, metric)


def overage_rate(plan="plan_id", metric="event_type") -> Column:
    return _by_plan(2, "decimal(10,4)", plan, metric)


def usage_by(events: DataFrame, *keys) -> DataFrame:
    """Long usage per key and event type."""
    return events.groupBy(*keys, "event_type").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("events"))


def tenant_usage(events: DataFrame, *keys, start=None, end=None) -> DataFrame:
    """Wide usage per key with estimated cost."""
    rows = events
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    wide = rows.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("event_type") == m, F.col("quantity"))).alias(m) for m in METRICS], F.count(F.lit(1)).alias("event_count")
    )
    zero = F.lit(Decimal("0"))
    cost = sum((F.coalesce(F.col(m), zero) * F.lit(p) for m, p in PRICES.items()), zero)
    return wide.withColumn("estimated_cost", cost)


def hourly_usage(events: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    return events.groupBy(hour, "tenant_id", "event_type").agg(F.sum("quantity").alias("quantity"))


def platform_hours(events: DataFrame) -> DataFrame:
    """Platform totals and active tenants per hour, from the tenant rollup."""
    h = hourly_usage(events)
    tenants = h.groupBy("hour").agg(F.countDistinct("tenant_id").alias("active_tenants"), F.sum("quantity").alias("total_usage"))
    return tenants


def top_tenants(events: DataFrame, k: int = 10) -> DataFrame:
    return events.groupBy("tenant_id").agg(F.sum("quantity").alias("total_usage")).orderBy(F.desc("total_usage"), "tenant_id").limit(k)


def with_plan(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    return join_unique(usage, accounts, "tenant_id", "inner")


def usage_percentage(used="quantity", plan="plan_id", metric="event_type") -> Column:
    return F.col(used).cast("double") / included(plan, metric).cast("double") * 100


def usage_alerts(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    pct = F.col("usage_percentage")
    return (
        with_plan(usage, accounts)
        .withColumn("usage_percentage", usage_percentage())
        .where(pct > 80)
        .withColumn("severity", F.when(pct > 95, F.lit("high")).otherwise(F.lit("medium")))
    )


def events_from_runs(runs: DataFrame) -> DataFrame:
    """Usage events a run gives rise to: data volume and compute time."""
    made = F.array(
        F.struct(F.lit("gb_processed").alias("event_type"), F.col("gb_processed").cast("decimal(18,6)").alias("quantity")),
        F.struct(
            F.lit("compute_hours").alias("event_type"),
            (F.col("execution_time_seconds") / F.lit(Decimal("3600"))).cast("decimal(18,6)").alias("quantity"),
        ),
        F.struct(F.lit("quality_checks").alias("event_type"), F.lit(1).cast("decimal(18,6)").alias("quantity")),
    )
    return runs.select("tenant_id", "pipeline_id", F.col("started_at").alias("timestamp"), F.inline(made))


def cost_rollup(events: DataFrame) -> DataFrame:
    """Cost per component and pipeline with subtotals."""
    priced = events.where(price().isNotNull()).withColumn("cost", F.col("quantity") * price())
    return priced.rollup("event_type", "pipeline_id").agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("records")
    ).withColumn("cost_per_record", F.col("cost").cast("double") / F.col("records"))


# -- invoices --------------------------------------------------------------

def charges(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    """Overage lines per tenant and metric, rounded half up to cents."""
    rows = with_plan(usage, accounts)
    over = F.greatest(F.col("quantity") - included(), F.lit(Decimal("0")))
    return rows.withColumns({"overage": over, "unit_price": overage_rate()}).withColumn(
        "line_cost", F.round(F.col("overage") * F.col("unit_price"), 2).cast("decimal(18,2)")
    )


def invoices(usage: DataFrame, accounts: DataFrame, as_of: dt.date) -> DataFrame:
    """One invoice per account; an account without usage pays its base fee."""
    line = F.struct(F.col("event_type").alias("metric"), "overage", "unit_price", "line_cost")
    lines = (
        charges(usage, accounts)
        .groupBy("tenant_id")
        .agg(
            F.sum("line_cost").alias("total_usage_cost"),
            F.sort_array(F.collect_list(F.when(F.col("line_cost") > 0, line))).alias("usage_charges"),
        )
    )
    fee = F.when(F.col("billing_period") == "annual", plan_fee() * F.lit(ANNUAL)).otherwise(plan_fee()).cast("decimal(18,2)")
    out = accounts.join(lines, "tenant_id", "left").withColumns(
        {"base_fee": fee, "total_usage_cost": F.coalesce("total_usage_cost", F.lit(Decimal("0.00")))}
    )
    out = out.withColumn("subtotal", F.col("base_fee") + F.col("total_usage_cost"))
    out = out.withColumn("tax_amount", F.round(F.col("subtotal") * F.lit(TAX), 2).cast("decimal(18,2)"))
    return out.withColumns(
        {
            "total_amount": F.col("subtotal") + F.col("tax_amount"),
            "invoice_id": F.concat_ws("_", F.lit("inv"), "tenant_id", F.date_format("current_period_end", "yyyyMMdd")),
            "due_date": F.date_add(F.lit(as_of), 30),
            "status": F.lit("pending"),
        }
    )


def next_period(accounts: DataFrame, as_of: dt.date) -> DataFrame:
    """Move due accounts into their next period; others are returned unchanged."""
    due = F.col("current_period_end") < F.lit(as_of)
    start = F.date_add("current_period_end", 1)
    end = F.when(F.col("billing_period") == "monthly", F.last_day(start)).otherwise(F.date_sub(F.add_months(start, 12), 1))
    return accounts.withColumn("due", due).withColumns(
        {
            "current_period_start": F.when(F.col("due"), start).otherwise(F.col("current_period_start")),
            "current_period_end": F.when(F.col("due"), end).otherwise(F.col("current_period_end")),
        }
    ).withColumn("next_billing_date", F.date_add("current_period_end", 1))


def invoice_history(events: DataFrame, accounts: DataFrame, days: int) -> DataFrame:
    """One invoice per account and period of ``days`` days that has usage, periods counted from the account's start.

    Allowance and base fee are those of the plan for each period.  Usage before the account's start is not billed.
    """
    begun = F.datediff(F.col("timestamp").cast("date"), "current_period_start")
    start = F.date_add("current_period_start", (F.floor(begun / days) * days).cast("int"))
    terms = accounts.select("tenant_id", "plan_id", "billing_period", "current_period_start")
    # Days first: what meets the accounts has one row per tenant, metric and day, not one per event.
    daily = events.groupBy("tenant_id", "event_type", F.col("timestamp").cast("date").alias("timestamp")).agg(
        F.sum("quantity").alias("quantity"))
    used = (
        join_unique(daily, terms, "tenant_id", "inner").where(begun >= 0)
        .groupBy("tenant_id", "plan_id", "billing_period", start.alias("period_start"), "event_type")
        .agg(F.sum("quantity").alias("quantity"))
    )
    over = F.greatest(F.col("quantity") - included(), F.lit(Decimal("0")))
    cost = F.round(over * overage_rate(), 2).cast("decimal(18,2)")
    fee = F.when(F.col("billing_period") == "annual", plan_fee() * F.lit(ANNUAL)).otherwise(plan_fee()).cast("decimal(18,2)")
    sums = used.groupBy("tenant_id", "plan_id", "billing_period", "period_start").agg(F.sum(cost).alias("total_usage_cost"))
    out = sums.withColumn("subtotal", fee + F.coalesce("total_usage_cost", F.lit(Decimal("0.00"))))
    return out.select(
        "tenant_id", "period_start", F.date_add("period_start", days - 1).alias("period_end"),
        F.concat_ws("_", F.lit("inv"), "tenant_id", F.date_format("period_start", "yyyyMMdd")).alias("invoice_id"),
        (F.col("subtotal") + F.round(F.col("subtotal") * F.lit(TAX), 2).cast("decimal(18,2)")).alias("total_amount"),
    )


def billing_view(events: DataFrame, accounts: DataFrame, days: int, last: int = 5) -> DataFrame:
    """One row per account: its terms, usage against limits per metric, and its ``last`` newest invoices, newest first.

    Accounts without usage have empty arrays.  ``last`` bounds what is gathered per account; the rank is
    filtered per task before the invoices travel.
    """
    newest = Window.partitionBy("tenant_id").orderBy(F.desc("period_start"))
    recent = (
        invoice_history(events, accounts, days).withColumn("position", F.row_number().over(newest)).where(F.col("position") <= last)
        .groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct(
            "position", "invoice_id", "period_start", "period_end", "total_amount"))).alias("recent_invoices"))
    )
    use = with_plan(usage_by(events, "tenant_id"), accounts).groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("event_type").alias("metric"), "quantity", included().alias("included"), usage_percentage().alias("percentage")))).alias("usage"))
    none = lambda c, df: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    return accounts.join(use, "tenant_id", "left").join(recent, "tenant_id", "left").select(
        "tenant_id", "plan_id", "billing_period", "current_period_start", "current_period_end",
        F.date_add("current_period_end", 1).alias("next_billing_date"), plan_fee().alias("base_monthly_fee"),
        none("usage", use), none("recent_invoices", recent))
