"""Bronze, silver and gold claim tables as DataFrame functions.

The same functions serve batch frames and, where no look-up over the table's
own history is needed, streams.  ``as_of`` is always a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.functions import codes as C
from dqflow.functions.scalars import freshness_hours, is_true
from dqflow.operators import expect as E
from dqflow.operators import scores as S
from dqflow.operators.skew import first_per_key, look_up, look_up_and_flag
from dqflow.operators.timeline import covered, interval_cover

OPEN_END = dt.date(2099, 12, 31)
DUPLICATE_KEY = ("member_id", "provider_npi", "date_of_service", "procedure_code")


def _stamp(as_of):
    return F.lit(as_of).cast("timestamp_ntz")


def any_value(df: DataFrame):
    """At least one column of the row holds a value."""
    return F.coalesce(*[F.col(c).cast("string") for c in df.columns]).isNotNull()


# -- bronze ----------------------------------------------------------------

def bronze_claim_rules(df: DataFrame):
    return [
        E.Expectation("valid_record", F.col("record_id").isNotNull(), "drop"),
        E.Expectation("valid_timestamp", F.col("_ingestion_timestamp").isNotNull(), "drop"),
        E.Expectation("non_empty_data", any_value(df), "drop"),
    ]


def bronze_claims(raw: DataFrame, as_of) -> DataFrame:
    return E.keep(raw, bronze_claim_rules(raw)).withColumns(
        {"_bronze_timestamp": _stamp(as_of), "_data_freshness_hours": freshness_hours("_ingestion_timestamp", as_of)}
    )


def bronze_members(raw: DataFrame, as_of) -> DataFrame:
    rules = [
        E.Expectation("valid_member_id", F.col("member_id").isNotNull(), "drop"),
        E.Expectation("valid_eligibility", F.col("eligibility_start").isNotNull(), "drop"),
    ]
    return E.keep(raw, rules).withColumn("_bronze_timestamp", _stamp(as_of))


def bronze_providers(raw: DataFrame, as_of) -> DataFrame:
    rules = [
        E.Expectation("valid_npi", F.length("provider_npi") == 10, "drop"),
        E.Expectation("valid_provider", F.col("provider_name").isNotNull(), "drop"),
    ]
    return E.keep(raw, rules).withColumn("_bronze_timestamp", _stamp(as_of))


# -- silver ----------------------------------------------------------------

def silver_claim_rules(as_of: dt.date, minimum: dt.date):
    """Six warnings on the row itself, three quarantine rules on other rows."""
    return [
        E.Expectation("valid_member_id", C.is_member_id_silver("member_id")),
        E.Expectation("valid_service_date", C.is_service_date("date_of_service", as_of, minimum)),
        E.Expectation("valid_npi", C.is_npi_format("provider_npi")),
        E.Expectation("valid_diagnosis", C.is_diagnosis_silver("diagnosis_code")),
        E.Expectation("valid_procedure", C.is_procedure("procedure_code")),
        E.Expectation("reasonable_amount", C.is_claim_amount("claim_amount")),
        E.Expectation("member_eligibility", F.col("_eligible"), "quarantine"),
        E.Expectation("provider_active", F.col("_provider_active"), "quarantine"),
        E.Expectation("no_duplicate_claims", ~F.col("_duplicate"), "quarantine"),
    ]


def member_attributes(members: DataFrame) -> DataFrame:
    """What gold claims take of the members, one row per member, so that no claim can multiply."""
    m = members.select("member_id", "eligibility_start", "eligibility_end", "plan_type")
    return first_per_key(m, "member_id", ["eligibility_start"])


def silver_flags(bronze: DataFrame, eligibility: DataFrame, providers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Eligibility, provider status and duplicate flags for every claim; with ``members`` their attributes as well.

    Everything that is known by member comes with one look-up, and claims of one duplicate key share a member.
    """
    by_member = interval_cover(eligibility, "member_id", "start_date", "end_date", OPEN_END)
    if members is not None:
        by_member = by_member.join(member_attributes(members), "member_id", "full")
    rows = look_up_and_flag(bronze, by_member, "member_id", DUPLICATE_KEY, ["created_date", "claim_id"], "_duplicate")
    rows = rows.withColumn("_eligible", covered(F.col("cover"), F.col("date_of_service"))).drop("cover")
    active = providers.groupBy("provider_npi").agg(F.bool_or(F.col("status") == "ACTIVE").alias("_provider_active"))
    rows = look_up(rows, active, "provider_npi", source=bronze)
    return rows.withColumn("_provider_active", is_true(F.col("_provider_active")))


def silver_rows(bronze, eligibility, providers, as_of: dt.date, members: DataFrame | None = None) -> DataFrame:
    """Every bronze claim with its flags and scores: what the clean claims and the quarantine are cut from."""
    scored = bronze.withColumns({"_silver_timestamp": _stamp(as_of), "_quality_score": S.quality_score(), "_anomaly_score": S.anomaly_score()})
    return silver_flags(scored, eligibility, providers, members)


def split_silver(rows: DataFrame, as_of: dt.date, minimum: dt.date) -> tuple[DataFrame, DataFrame]:
    """Clean claims and the quarantined rest of ``silver_rows``."""
    clean, bad = E.split(rows, silver_claim_rules(as_of, minimum), as_of)
    flags = ("_eligible", "_provider_active", "_duplicate")
    return clean.drop(*flags), bad.drop(*flags)


def silver_claims(bronze, eligibility, providers, as_of: dt.date, minimum: dt.date) -> tuple[DataFrame, DataFrame]:
    """Scored clean claims and the quarantined rest."""
    return split_silver(silver_rows(bronze, eligibility, providers, as_of), as_of, minimum)


def silver_members(bronze: DataFrame, as_of: dt.date) -> DataFrame:
    day = F.lit(as_of)
    eligible = (F.col("eligibility_start") <= day) & (F.col("eligibility_end").isNull() | (F.col("eligibility_end") >= day))
    rules = [
        E.Expectation("valid_member_format", F.col("member_id").rlike("^[A-Z0-9]{8,12}$")),
        E.Expectation("valid_eligibility_dates", F.col("eligibility_start") <= F.coalesce("eligibility_end", day)),
    ]
    return E.evaluate(bronze, rules).withColumns({"_silver_timestamp": _stamp(as_of), "_is_currently_eligible": is_true(eligible)})


def silver_providers(bronze: DataFrame, as_of: dt.date) -> DataFrame:
    rules = [
        E.Expectation("valid_npi_format", C.is_npi_format("provider_npi")),
        E.Expectation("valid_taxonomy", C.is_taxonomy_silver("taxonomy_code")),
    ]
    return E.evaluate(bronze, rules).withColumns(
        {"_silver_timestamp": _stamp(as_of), "_npi_checksum_valid": C.npi_checksum("provider_npi")}
    )


# -- quarantine by score and content ---------------------------------------

def quarantine_rules():
    return [
        E.Expectation("critical_validation_failure", F.col("_quality_score") >= 0.6, "quarantine"),
        E.Expectation("missing_required_fields", F.col("member_id").isNotNull() & F.col("claim_id").isNotNull(), "quarantine"),
        E.Expectation(
            "invalid_healthcare_codes",
            F.col("diagnosis_code").rlike("^[A-TV-Z][0-9]") | F.col("procedure_code").rlike("^[0-9]{5}$"),
            "quarantine",
        ),
    ]


# -- gold ------------------------------------------------------------------

def gold_admission_rules():
    return [
        E.Expectation("high_quality_data", F.col("_quality_score") >= 0.8),
        E.Expectation("recent_data", F.col("_data_freshness_hours") <= 24),
        E.Expectation(
            "complete_clinical_data",
            F.col("diagnosis_code").isNotNull() & F.col("procedure_code").isNotNull() & F.col("provider_npi").isNotNull(),
        ),
    ]


def gold_claims(silver: DataFrame, members: DataFrame | None, providers: DataFrame | None, as_of, source: DataFrame | None = None) -> DataFrame:
    """Claims with member and provider attributes; the claim count is preserved.

    Dimensions are reduced to one row per key first, so that no claim can
    multiply.  Without ``members`` the claims have their members' attributes
    from ``silver_rows`` or their source; without ``providers`` they get none of providers.
    ``source`` is a cheaper table with the same provider keys.
    """
    rows = silver.where("_quality_score >= 0.7")
    if members is not None:
        rows = look_up(rows, member_attributes(members), "member_id", source=silver)
    if providers is not None:
        p = providers.select("provider_npi", "provider_name", "provider_specialty", "provider_state")
        p = first_per_key(p, "provider_npi", ["provider_name"])
        rows = look_up(rows, p, "provider_npi", source=silver if source is None else source)
    return rows.withColumns(
        {
            "_gold_timestamp": _stamp(as_of),
            "_business_rule_score": S.business_rule_score(),
            "claim_year": F.year("date_of_service"),
            "claim_month": F.month("date_of_service"),
            "provider_risk_category": S.risk_category(),
        }
    )
