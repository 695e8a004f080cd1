"""Gold marts and table metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqflow.functions.scalars import rate
from dqflow.operators import scores as S
from dqflow.operators.skew import first_per_key, hot_keys, look_up
from dqflow.sources.tables import stored_layer


def mean(total, n):
    """Mean from an exact decimal sum, so the order of rows never shows."""
    return total.cast("double") / n


def per_group(rows: DataFrame, by: str, keys: list, aggs: list, distinct: dict, source: DataFrame | None = None) -> DataFrame:
    """Aggregates and exact distinct counts (name: column) per group of ``keys``, ``by`` among them.

    Rows travel once, as they are: a task then holds one group's values at a time.  That is for keys below
    their share of rows; groups of hot or NULL ``by`` are counted with partial aggregates.  ``source`` is a cheaper table with
    the same keys.
    """
    hot = [r[0] for r in hot_keys(rows if source is None else source, by).collect()]
    large = F.col(by).isNull() | F.col(by).isin(hot)
    values = {n: F.size(F.collect_set(c)).cast("bigint").alias(n) for n, c in distinct.items()}
    few = rows.where(~large).repartition(*keys).groupBy(*keys).agg(*aggs, *values.values())
    return few.unionByName(rows.where(large).groupBy(*keys).agg(*aggs, *[F.countDistinct(c).alias(n) for n, c in distinct.items()]))


def provider_performance(gold: DataFrame, providers: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """Providers by month; claims without provider attributes get them from ``providers`` once they are grouped."""
    names = ["provider_name", "provider_specialty"]
    keys = ["provider_npi", *(names if providers is None else []), "claim_year", "claim_month"]
    aggs = [
        F.count(F.lit(1)).alias("total_claims"),
        F.sum("claim_amount").alias("_amount"),
        F.sum(F.col("_quality_score").cast("decimal(4,1)")).alias("_q"),
        F.sum(F.col("_anomaly_score").cast("decimal(4,1)")).alias("_a"),
    ]
    distinct = {"unique_patients": "member_id", "unique_diagnoses": "diagnosis_code", "unique_procedures": "procedure_code"}
    rows = gold.select(*keys, "claim_amount", "_quality_score", "_anomaly_score", *distinct.values())
    out = per_group(rows, "provider_npi", keys, aggs, distinct, source)
    if providers is not None:
        p = first_per_key(providers.select("provider_npi", *names), "provider_npi", names[:1])
        out = look_up(out, p, "provider_npi", source=out if source is None else source)
    n = F.col("total_claims")
    return out.select(
        "provider_npi",
        *names,
        "claim_year",
        "claim_month",
        "total_claims",
        F.col("_amount").cast("double").alias("total_amount"),
        mean(F.col("_amount"), n).alias("avg_claim_amount"),
        mean(F.col("_q"), n).alias("avg_quality_score"),
        mean(F.col("_a"), n).alias("avg_anomaly_score"),
        "unique_patients",
        "unique_diagnoses",
        "unique_procedures",
        F.round((1 - F.col("_a").cast("double") / n) * (F.col("_q").cast("double") / n), 6).alias("performance_score"),
    )


def member_utilization(gold: DataFrame, source: DataFrame | None = None) -> DataFrame:
    keys = ["member_id", "plan_type", "claim_year", "claim_month"]
    aggs = [
        F.count(F.lit(1)).alias("total_claims"),
        F.sum("claim_amount").alias("_amount"),
        F.max("date_of_service").alias("last_service_date"),
    ]
    distinct = {"unique_providers": "provider_npi", "unique_conditions": "diagnosis_code", "unique_procedures": "procedure_code"}
    rows = gold.select(*keys, "claim_amount", "date_of_service", *distinct.values())
    out = per_group(rows, "member_id", keys, aggs, distinct, source)
    return out.select(
        *keys,
        "total_claims",
        F.col("_amount").cast("double").alias("total_spending"),
        mean(F.col("_amount"), F.col("total_claims")).alias("avg_claim_amount"),
        "unique_providers",
        "unique_conditions",
        "unique_procedures",
        F.date_format("last_service_date", "yyyy-MM-dd").alias("last_service_date"),
        S.utilization_category(F.col("total_claims")).alias("utilization_category"),
        S.cost_category(F.col("_amount")).alias("cost_category"),
    )


def _score_aggs():
    q, a = F.col("_quality_score").cast("decimal(4,1)"), F.col("_anomaly_score").cast("decimal(4,1)")
    return {
        "records": F.count(F.lit(1)),
        "q_sum": F.sum(q),
        "q_min": F.min(q),
        "q_max": F.max(q),
        "a_sum": F.sum(a),
        "high_quality": F.count_if(q >= 0.8),
        "low_quality": F.count_if(q < 0.5),
        "high_anomaly": F.count_if(a > 0.7),
    }


def hourly_quality(df: DataFrame, ts="_ingestion_timestamp") -> DataFrame:
    out = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(*[v.alias(k) for k, v in _score_aggs().items()])
    avg_q = F.col("q_sum").cast("double") / F.col("records")
    return out.select(
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("quality_hour"),
        F.col("records").alias("total_records"),
        avg_q.alias("avg_quality_score"),
        F.col("q_min").cast("double").alias("min_quality_score"),
        F.col("q_max").cast("double").alias("max_quality_score"),
        mean(F.col("a_sum"), F.col("records")).alias("avg_anomaly_score"),
        F.col("high_quality").alias("high_quality_records"),
        F.col("low_quality").alias("low_quality_records"),
        F.col("high_anomaly").alias("high_anomaly_records"),
        S.quality_trend(avg_q).alias("quality_trend"),
    )


def table_metrics(df: DataFrame) -> DataFrame:
    """Quality, anomaly and freshness metrics of a scored table in one scan."""
    f = F.col("_data_freshness_hours")
    out = df.agg(
        *[v.alias(k) for k, v in _score_aggs().items()],
        F.sum(f.cast("decimal(12,4)")).alias("f_sum"), F.max(f).alias("f_max"), F.count_if(f > 24).alias("stale"),
    )
    n = F.col("records")
    return out.select(
        n.alias("total_records"),
        mean(F.col("q_sum"), n).alias("avg_quality_score"),
        F.col("q_min").cast("double").alias("min_quality_score"),
        F.col("q_max").cast("double").alias("max_quality_score"),
        rate(F.col("high_quality"), n).alias("high_quality_percentage"),
        rate(F.col("low_quality"), n).alias("low_quality_percentage"),
        rate(F.col("high_anomaly"), n).alias("high_anomaly_percentage"),
        mean(F.col("a_sum"), n).alias("avg_anomaly_score"),
        mean(F.col("f_sum"), n).alias("avg_freshness_hours"),
        F.round("f_max", 6).alias("max_freshness_hours"),
        rate(F.col("stale"), n).alias("stale_percentage"),
    )


# User metrics as SQL aggregates.
CUSTOM_METRICS = {
    "member_id_completeness": "count(member_id) / count(*)",
    "claim_amount_outliers": "count_if(claim_amount > 50000) / count(*)",
    "diagnosis_code_validity": "count_if(diagnosis_code RLIKE '^[A-TV-Z][0-9][A-Z0-9]') / count(*)",
    "npi_format_compliance": "count_if(provider_npi RLIKE '^[0-9]{10}$') / count(*)",
    "data_freshness_hours": "avg(_data_freshness_hours)",
}


def custom_metrics(df: DataFrame, definitions: dict | None = None) -> DataFrame:
    """Metrics given as SQL aggregate text, all in one pass."""
    d = CUSTOM_METRICS if definitions is None else definitions
    return df.agg(*[F.round(F.expr(text).cast("double"), 6).alias(name) for name, text in d.items()])


def weighted_quality(df: DataFrame, since, as_of) -> DataFrame:
    """Completeness, validity and business averages weighted .25/.30/.45."""
    n = F.count(F.lit(1))

    def share(cond):
        return F.count_if(cond) / n * 100

    m = df.where(F.col("created_date") >= F.lit(since)).agg(
        n.alias("total_records"),
        ((share(F.col("member_id").isNotNull()) + share(F.col("provider_npi").isNotNull())) / 2).alias("c"),
        (
            (
                share(F.col("provider_npi").rlike("^[0-9]{10}$"))
                + share(F.col("diagnosis_code").rlike(r"^[A-TV-Z][0-9][A-Z0-9](\.[A-Z0-9]{0,4})?$"))
            ) / 2
        ).alias("v"),
        ((share(F.col("claim_amount") > 0) + share(F.col("date_of_service") <= F.lit(as_of))) / 2).alias("b"),
    )
    return m.select(
        "total_records",
        F.round("c", 6).alias("avg_completeness"),
        F.round("v", 6).alias("avg_validity"),
        F.round("b", 6).alias("avg_business_rules"),
        F.round(F.col("c") * 0.25 + F.col("v") * 0.30 + F.col("b") * 0.45, 6).alias("overall_quality_score"),
    )


def claims_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.sum("claim_amount").cast("double").alias("total_amount"),
        mean(F.sum("claim_amount"), F.count("claim_amount")).alias("avg_amount"),
        F.countDistinct("member_id").alias("unique_members"),
        F.countDistinct("provider_npi").alias("unique_providers"),
    )


def top_providers(scored: DataFrame, k: int = 10) -> DataFrame:
    out = scored.groupBy("provider_npi").agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(F.col("_quality_score") > 0.9).alias("_high"),
    )
    return (
        out.select("provider_npi", "total_claims", rate(F.col("_high"), F.col("total_claims")).alias("high_quality_rate"))
        .orderBy(F.desc("total_claims"), "provider_npi")
        .limit(k)
    )


def by_diagnosis_category(df: DataFrame) -> DataFrame:
    return df.groupBy(F.left("diagnosis_code", F.lit(1)).alias("category")).agg(
        F.count(F.lit(1)).alias("claims"), F.sum("claim_amount").cast("double").alias("total_amount")
    )


def duplicate_groups(df: DataFrame, keys, since=None, day="created_date") -> DataFrame:
    rows = df if since is None else df.where(F.col(day) >= F.lit(since))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1")


def quarantine_reasons(bad: DataFrame) -> DataFrame:
    return (
        bad.select(F.explode(F.split("failed_expectation", ",")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def share_of_total(bad: DataFrame, day) -> DataFrame:
    """Rows per day and reason with their share of all rows; the window sees groups only."""
    g = bad.select(F.col(day).alias("day"), F.explode(F.split("failed_expectation", ",")).alias("reason")).groupBy("day", "reason").agg(
        F.count(F.lit(1)).alias("records")
    )
    g = stored_layer(g, "share-groups")  # few rows, read for the total and the shares
    total = g.agg(F.sum("records")).scalar()
    return g.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "reason", "records",
        F.round(F.col("records") * 100.0 / total, 6).alias("percentage"),
    )


def history(df: DataFrame, ts, granularity: str, value="_quality_score") -> DataFrame:
    """Average score per hour, day or week with the change to the period before.

    The lag window orders one row per period, never the table itself.
    """
    g = df.groupBy(F.date_trunc(granularity, F.col(ts)).alias("period")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col(value).cast("decimal(12,4)")).alias("_s")
    )
    g = g.withColumn("avg_score", mean(F.col("_s"), F.col("records"))).drop("_s")
    prev = F.lag("avg_score").over(W.orderBy("period"))
    change = F.round(F.col("avg_score") - F.col("previous_score"), 6)
    return g.withColumn("previous_score", prev).select(
        F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "records", "avg_score", "previous_score",
        F.when(F.col("previous_score").isNull() | (change == 0), F.lit("stable")).when(change > 0, F.lit("up")).otherwise(F.lit("down")).alias("trend"),
    )


def code_validation_rates(df: DataFrame) -> DataFrame:
    """Share of valid codes per kind, from one scan."""
    from dqflow.functions import codes as C

    checks = {
        "npi": C.validate_npi("provider_npi")["valid"],
        "icd10": C.is_diagnosis_loose("diagnosis_code"),
        "cpt": C.is_cpt_format("procedure_code"),
        "member_id": C.validate_member_id("member_id")["valid"],
    }
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("code_type"), F.col(k).alias("valid"), F.col("n").alias("total")) for k in checks])
    return wide.select(F.inline(rows)).select("code_type", "valid", "total", rate(F.col("valid"), F.col("total")).alias("valid_rate"))
