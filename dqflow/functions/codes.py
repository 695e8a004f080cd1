"""Domain validators as Column expressions.

``validate_*`` builders return ``struct<valid, clean_value, format, error,
warning>``; ``is_*`` builders return a plain boolean that is never NULL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.scalars import col_of, digits, is_true, parse_date

# Identifier and code patterns.
MEMBER_ID_PATTERNS = (
    r"^\d{9,12}$",
    r"^[A-Z]{1,3}\d{6,9}$",
    r"^[A-Z]{2}\d{8}[A-Z]$",
    r"^\d{9}[A-Z]?\d?[A-Z]?$",
    r"^[A-Z]\d{8}[A-Z]$",
)
MEMBER_ID_ENGINE_PATTERNS = (r"^[0-9]{9,12}$", r"^[A-Z]{1,3}[0-9]{6,9}$", r"^[A-Z][0-9]{8}[A-Z]$")
MEMBER_ID_SILVER_PATTERNS = (r"^[0-9]{9,12}$", r"^[A-Z]{1,3}[0-9]{6,9}$")
ICD10_STRICT = r"^[A-TV-Z][0-9][A-Z0-9](\.[A-Z0-9]{1,4})?$"
ICD10_LOOSE = r"^[A-TV-Z][0-9][A-Z0-9](\.[A-Z0-9]{0,4})?$"
ICD9 = r"^\d{3}(\.\d{1,2})?$"
ICD9_LOOSE = r"^[0-9]{3}(\.[0-9]{0,2})?$"
CPT = r"^[0-9]{5}$"
HCPCS = r"^[A-HJKLMNP-V][0-9]{4}$"
HCPCS_WIDE = r"^[A-V][0-9]{4}$"
NDC_FORMATS = {
    "5-4-2": r"^\d{5}-\d{4}-\d{2}$",
    "4-4-2": r"^\d{4}-\d{4}-\d{2}$",
    "5-3-2": r"^\d{5}-\d{3}-\d{2}$",
    "11-digit": r"^\d{11}$",
}
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?[0-9]{10}$"
ZIP = r"^[0-9]{5}(-[0-9]{4})?$"
SSN = r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$"
CLAIM_ID = r"^[A-Z0-9]{10,20}$"
STATE_MEMBER_ID = {"CA": r"^CA[0-9]{9}$", "NY": r"^[0-9]{8}NY$", "TX": r"^TX[A-Z][0-9]{8}$"}

# Meaning of the first letter of a level II procedure code.
HCPCS_CATEGORIES = {
    "A": "Transportation, Medical and Surgical Supplies",
    "B": "Enteral and Parenteral Therapy",
    "C": "Outpatient PPS",
    "D": "Dental Procedures",
    "E": "Durable Medical Equipment",
    "G": "Procedures/Professional Services (Temporary)",
    "H": "Alcohol and Drug Abuse Treatment Services",
    "J": "Drugs Administered Other Than Oral Method",
    "K": "Temporary Codes",
    "L": "Orthotic/Prosthetic Procedures",
    "M": "Medical Services",
    "P": "Pathology and Laboratory Services",
    "Q": "Temporary Codes",
    "R": "Diagnostic Radiology Services",
    "S": "Temporary National Codes",
    "T": "National T-Codes",
    "V": "Vision Services",
}

# State programme lists.
CA_PLANS = ("ANTHEM", "BLUE_CROSS", "HEALTH_NET", "KAISER", "LA_CARE")
CA_AID_CODES = ("01", "02", "03", "04", "05")
CA_MAX_CLAIM = 50000
TX_DUAL_ELIGIBLE = ("01", "02", "03")
GENDERS = ("M", "F", "U", "X")
PROVIDER_TYPES = ("Individual", "Organization")
CLAIM_STATUSES = ("SUBMITTED", "PROCESSING", "PAID", "DENIED", "PENDING")

# Fields each entity must carry.
REQUIRED_FIELDS = {
    "member": ("member_id", "first_name", "last_name", "date_of_birth", "gender"),
    "claim": (
        "claim_id", "member_id", "provider_npi", "diagnosis_code", "procedure_code", "date_of_service", "claim_amount",
    ),
    "provider": ("provider_npi", "provider_name", "provider_type", "license_number"),
}
# Completeness targets in percent.
COMPLETENESS_TARGETS = {"critical": 100.0, "required": 95.0, "conditional": 98.0}
CRITICAL_FIELDS = ("member_id", "provider_npi", "date_of_service", "claim_id")
EXPECTED_FIELDS = ("diagnosis_code", "procedure_code", "claim_amount", "place_of_service")

MEDICARE_PART_FIELDS = {
    "A": ("medicare_beneficiary_id", "provider_npi", "admission_date", "discharge_date", "drg_code", "total_charges"),
    "B": ("medicare_beneficiary_id", "provider_npi", "date_of_service", "procedure_code", "diagnosis_code"),
    "D": (
        "medicare_beneficiary_id", "prescriber_npi", "pharmacy_npi", "ndc_code", "quantity_dispensed", "days_supply",
    ),
}


def any_match(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return is_true(out)


def result(valid: Column, clean: Column, error: str, fmt: Column | None = None, warning: Column | None = None) -> Column:
    valid = is_true(valid)
    none = F.lit(None).cast("string")
    return F.struct(
        valid.alias("valid"),
        F.when(valid, clean.cast("string")).alias("clean_value"),
        (F.when(valid, fmt) if fmt is not None else none).alias("format"),
        F.when(~valid, F.lit(error)).alias("error"),
        (F.when(valid, warning) if warning is not None else none).alias("warning"),
    )


# -- identifiers -----------------------------------------------------------

def validate_member_id(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    return result(any_match(clean, MEMBER_ID_PATTERNS), clean, "invalid member id")


def is_member_id_engine(c) -> Column:
    return any_match(F.upper(col_of(c)), MEMBER_ID_ENGINE_PATTERNS)


def is_member_id_silver(c) -> Column:
    return any_match(col_of(c), MEMBER_ID_SILVER_PATTERNS)


def luhn(c) -> Column:
    """Plain mod-10 check; false for NULL, empty or non-digit text."""
    c = col_of(c)
    return is_true(c.rlike("^[0-9]+$") & F.call_function("luhn_check", c))


def npi_checksum(c) -> Column:
    """Mod-10 over the number with the issuer prefix 80840."""
    return is_true(luhn(F.concat(F.lit("80840"), col_of(c))))


def validate_npi(c) -> Column:
    d = digits(c)
    ok = (F.length(d) == 10) & ~d.isin("0000000000", "9999999999") & npi_checksum(d)
    return result(ok, d, "invalid NPI")


def is_npi_format(c) -> Column:
    c = col_of(c)
    return is_true(c.rlike("^[0-9]{10}$") & ~c.isin("0000000000", "9999999999"))


# -- clinical codes --------------------------------------------------------

def validate_diagnosis(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    ten, nine = clean.rlike(ICD10_STRICT), clean.rlike(ICD9)
    fmt = F.when(ten, F.lit("ICD-10")).otherwise(F.lit("ICD-9"))
    warning = F.when(~ten, F.lit("legacy ICD-9 format"))
    return result(ten | nine, clean, "invalid diagnosis code", fmt, warning)


def is_diagnosis_loose(c) -> Column:
    return is_true(col_of(c).rlike(ICD10_LOOSE))


def is_diagnosis_silver(c) -> Column:
    c = col_of(c)
    return is_true(c.rlike(ICD10_LOOSE) | c.rlike(ICD9_LOOSE))


def validate_icd10_extended(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    dot = F.instr(clean, ".")
    decimals = F.when(dot > 0, F.length(clean) - dot).otherwise(F.lit(0))
    error = (
        F.when(clean.isNull() | ~F.length(clean).between(3, 7), F.lit("length"))
        .when(F.substring(clean, 1, 1) == "U", F.lit("reserved first letter"))
        .when(~clean.rlike(ICD10_LOOSE), F.lit("format"))
        .when(F.substring(clean, 1, 1).isin("S", "T") & (dot == 0), F.lit("decimal required"))
        .when(decimals > 4, F.lit("too many decimals"))
    )
    return F.struct(error.isNull().alias("valid"), F.when(error.isNull(), clean).alias("clean_value"), error.alias("error"))


def validate_cpt(c) -> Column:
    d = digits(c)
    number = d.try_cast("int")
    return result((F.length(d) == 5) & number.between(100, 99999), d, "invalid CPT code")


def is_cpt_format(c) -> Column:
    return is_true(col_of(c).rlike(CPT))


def cpt_category(c) -> Column:
    c = F.upper(F.trim(col_of(c)))
    number = F.when(c.rlike(CPT), c.try_cast("int"))
    return (
        F.when(number.between(100, 99499), F.lit("I"))
        .when(c.rlike("^[0-9]{4}F$") & (c >= "0001F"), F.lit("II"))
        .when(c.rlike("^[0-9]{4}T$") & (c >= "0001T"), F.lit("III"))
        .otherwise(F.lit("none"))
    )


def validate_hcpcs(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    return result(clean.rlike(HCPCS), clean, "invalid HCPCS code")


def hcpcs_category(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    labels = F.create_map(*[F.lit(x) for pair in HCPCS_CATEGORIES.items() for x in pair])
    return F.when(clean.rlike(HCPCS_WIDE), F.try_element_at(labels, F.substring(clean, 1, 1)))


def is_procedure(c) -> Column:
    c = col_of(c)
    return is_true(c.rlike(CPT) | c.rlike(HCPCS_WIDE))


def ndc_format(c) -> Column:
    c = F.trim(col_of(c))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(NDC_FORMATS.items()):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def validate_ndc(c) -> Column:
    fmt = ndc_format(c)
    return result(fmt.isNotNull(), F.trim(col_of(c)), "invalid NDC code", fmt)


# -- dates, money, places --------------------------------------------------

def validate_service_date(c, as_of: dt.date, minimum: dt.date = dt.date(2020, 1, 1)) -> Column:
    d = parse_date(c)
    ok = (d >= F.lit(minimum)) & (d <= F.lit(as_of))
    return result(ok, F.date_format(d, "yyyy-MM-dd"), "invalid service date")


def is_service_date(c, as_of: dt.date, minimum: dt.date = dt.date(2020, 1, 1)) -> Column:
    return is_true(col_of(c).between(F.lit(minimum), F.date_add(F.lit(as_of), 30)))


def validate_claim_amount(c) -> Column:
    number = F.regexp_replace(col_of(c).cast("string"), r"[$,\s]", "").try_cast("decimal(18,4)")
    rounded = F.round(number, 2).cast("decimal(18,2)")
    return result(
        number.between(0, 1000000), rounded, "invalid claim amount", warning=F.when(number == 0, F.lit("zero amount"))
    )


def is_claim_amount(c) -> Column:
    return is_true(col_of(c).between(0, 1000000))


def is_reasonable_amount(c) -> Column:
    return is_true(col_of(c).between(1, 100000))


def validate_taxonomy(c) -> Column:
    clean = F.upper(F.trim(col_of(c)))
    return result(clean.rlike("^[A-Z0-9]{10}$"), clean, "invalid taxonomy code")


def is_taxonomy_silver(c) -> Column:
    c = col_of(c)
    return c.isNull() | (F.length(c) == 10)


def validate_place_of_service(c) -> Column:
    text = F.trim(col_of(c).cast("string"))
    padded = F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)
    return result(padded.rlike("^[0-9]{2}$") & padded.try_cast("int").between(1, 99), padded, "invalid place of service")


def validate_admission(admission, service) -> Column:
    a, s = parse_date(admission), parse_date(service)
    ok = a.isNotNull() & (s.isNull() | (a <= s))
    return result(ok, F.date_format(a, "yyyy-MM-dd"), "admission after service")


def validate_discharge(discharge, admission, max_stay: int = 365) -> Column:
    d, a = parse_date(discharge), parse_date(admission)
    ok = d.isNotNull() & (a.isNull() | (d >= a))
    warning = F.when(F.datediff(d, a) > max_stay, F.lit("stay longer than 365 days"))
    return result(ok, F.date_format(d, "yyyy-MM-dd"), "discharge before admission", warning=warning)


def is_generic_date(c, as_of: dt.date) -> Column:
    d = col_of(c).try_cast("date")
    return is_true(d.between(F.lit(dt.date(1900, 1, 1)), F.add_months(F.lit(as_of), 12)))


def age_years(dob, as_of: dt.date) -> Column:
    return F.datediff(F.lit(as_of), col_of(dob)) / F.lit(365.25)


def is_late_submission(service, submission, days: int = 90) -> Column:
    return is_true(col_of(submission) > F.date_add(col_of(service), days))


def is_weekend(c) -> Column:
    return F.dayofweek(col_of(c)).isin(1, 7)


# -- presence and implication ----------------------------------------------

def present(c) -> Column:
    """Not NULL and not blank."""
    c = col_of(c)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def implies(condition: Column, consequence: Column) -> Column:
    return ~is_true(condition) | is_true(consequence)


def state_member_id(state, member_id) -> Column:
    state, member_id = col_of(state), col_of(member_id)
    out = F.lit(False)
    for code, pattern in STATE_MEMBER_ID.items():
        out = F.when(state == code, is_true(member_id.rlike(pattern))).otherwise(out)
    return out


def state_programme_errors(state, plan, dual_code, amount) -> Column:
    """Which programme rules of a state a row breaks: plan, claim_amount (California), dual_code (Texas).

    A missing plan, code or amount breaks the rule of its state; other states have none of these rules.
    """
    state, plan, dual_code, amount = map(col_of, (state, plan, dual_code, amount))
    broken = {
        "plan": (state == "CA") & ~is_true(plan.isin(*CA_PLANS)),
        "claim_amount": (state == "CA") & ~is_true(amount <= CA_MAX_CLAIM),
        "dual_code": (state == "TX") & ~is_true(dual_code.isin(*TX_DUAL_ELIGIBLE)),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]))


def medicare_part_complete(part, available) -> Column:
    """True when every field the part requires is present; unknown parts pass.

    ``available`` maps a field name to its column.
    """
    part = col_of(part)
    out = F.lit(True)
    for code, fields in MEDICARE_PART_FIELDS.items():
        complete = F.lit(True)
        for f in fields:
            complete = complete & (present(available[f]) if f in available else F.lit(False))
        out = F.when(part == code, complete).otherwise(out)
    return out


def is_drg(c) -> Column:
    c = col_of(c)
    return is_true(c.rlike("^[0-9]{3}$") & (c != "000"))


# -- whole records ---------------------------------------------------------

VALIDATORS = {
    "member_id": validate_member_id,
    "npi": validate_npi,
    "icd10_diagnosis": validate_diagnosis,
    "cpt_procedure": validate_cpt,
    "hcpcs_procedure": validate_hcpcs,
    "claim_amount": validate_claim_amount,
    "provider_taxonomy": validate_taxonomy,
    "place_of_service": validate_place_of_service,
}

# Default record schemas, field to validator name.
MEDICAID_SCHEMA = {
    "member_id": "member_id",
    "provider_npi": "npi",
    "diagnosis_code": "icd10_diagnosis",
    "procedure_code": "cpt_procedure",
    "service_date": "service_date",
    "claim_amount": "claim_amount",
    "provider_taxonomy": "provider_taxonomy",
}
MEDICARE_SCHEMA = {
    "member_id": "member_id",
    "provider_npi": "npi",
    "diagnosis_code": "icd10_diagnosis",
    "procedure_code": "hcpcs_procedure",
    "service_date": "service_date",
    "claim_amount": "claim_amount",
    "admission_date": "admission_date",
    "discharge_date": "discharge_date",
}


def field_validators(schema: dict, columns, as_of: dt.date, minimum: dt.date) -> tuple[dict, list]:
    """Validator struct per known field, and messages for what cannot be checked."""
    none = F.lit(None).cast("string")
    checks, problems = {}, []
    for field, name in schema.items():
        if field not in columns:
            problems.append(f"{field}: missing field")
        elif name == "service_date":
            checks[field] = validate_service_date(field, as_of, minimum)
        elif name == "admission_date":
            checks[field] = validate_admission(field, "service_date" if "service_date" in columns else none)
        elif name == "discharge_date":
            checks[field] = validate_discharge(field, "admission_date" if "admission_date" in columns else none)
        elif name in VALIDATORS:
            checks[field] = VALIDATORS[name](field)
        else:
            problems.append(f"{field}: unknown rule {name}")
    return checks, problems


def validate_records(df: DataFrame, schema: dict, as_of: dt.date, minimum: dt.date = dt.date(2020, 1, 1)) -> DataFrame:
    """Add ``valid``, ``errors``, ``warnings`` and ``fields`` for a whole record.

    An unknown validator name or a missing column becomes an error entry.  The
    field structs are columns of their own first, so that each validator runs
    once per row however often its outcome is used.
    """
    checks, problems = field_validators(schema, df.columns, as_of, minimum)
    marked = df.select("*", *[c.alias(f"_v_{f}") for f, c in checks.items()])

    def messages(part):
        found = [F.when(F.col(f"_v_{f}")[part].isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f"_v_{f}")[part])) for f in checks]
        return F.array_compact(F.array(*found).cast("array<string>"))

    errors = F.concat(messages("error"), F.array(*[F.lit(p) for p in problems]).cast("array<string>"))
    out = marked.select(
        *df.columns, errors.alias("errors"), messages("warning").alias("warnings"),
        F.struct(*[F.col(f"_v_{f}").alias(f) for f in checks]).alias("fields"),
    )
    return out.withColumn("valid", F.size("errors") == 0)


def validate_code(kind, value) -> Column:
    """Row-wise choice of validator for mixed lists of ``(type, value)``."""
    kind = F.lower(col_of(kind))
    choice = {"npi": validate_npi, "icd10": validate_diagnosis, "cpt": validate_cpt, "hcpcs": validate_hcpcs,
              "ndc": validate_ndc, "member_id": validate_member_id}
    unknown = result(F.lit(False), F.lit(None).cast("string"), "unknown code type")
    out = unknown
    for name, build in choice.items():
        out = F.when(kind == name, build(value)).otherwise(out)
    return out
