"""Identifier detection, masking, de-identified views and access audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.scalars import hash_id, mask_email, mask_phone, mask_ssn
from dqflow.operators.assess import one_pass

# Column names of direct and indirect identifiers.
DIRECT = (
    "member_id", "ssn", "medical_record_number", "account_number", "certificate_number", "license_number",
    "vehicle_identifier", "device_identifier", "biometric_identifier",
)
INDIRECT = (
    "name", "address", "birth", "admission_date", "discharge_date", "death_date", "phone", "fax", "email", "url", "zip",
)
FINANCIAL = ("amount", "charge", "price", "cost")
CLINICAL = ("diagnosis", "procedure", "drug", "ndc")

# Value patterns inside free text.
TEXT_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Whole-value patterns of a column.
VALUE_PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?1?[0-9]{10}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "zip": r"^[0-9]{5}(-[0-9]{4})?$",
}


def name_class(column: str) -> str | None:
    low = column.lower()
    if any(n in low for n in DIRECT):
        return "direct"
    if any(n in low for n in INDIRECT):
        return "indirect"
    return None


def tags(column: str) -> list[str]:
    low = column.lower()
    out = []
    if name_class(column) == "direct":
        out.append("PHI")
    if name_class(column):
        out.append("PII")
    if any(n in low for n in FINANCIAL):
        out.append("FINANCIAL")
    if any(n in low for n in CLINICAL):
        out.append("CLINICAL")
    return out


def classify_columns(df: DataFrame, min_rate: float = 0.2) -> DataFrame:
    """Identifier class per column from its name and its share of pattern hits."""
    texts = [c for c, t in df.dtypes if t == "string"]
    m = {f"{c}\x1f{p}": F.count_if(F.col(c).rlike(rx)) / F.count(c) for c in texts for p, rx in VALUE_PATTERNS.items()}
    hits = one_pass(df, m).select(F.split("key", "\x1f").alias("k"), F.coalesce("value", F.lit(0.0)).alias("hit_rate"))
    names = F.create_map(*[x for c in texts for x in (F.lit(c), F.coalesce(F.lit(name_class(c)), F.lit("none")))])
    tag = F.create_map(*[x for c in texts for x in (F.lit(c), F.lit(",".join(tags(c))))])
    best = hits.groupBy(F.col("k")[0].alias("column_name")).agg(
        F.max("hit_rate").alias("hit_rate"), F.max_by(F.col("k")[1], F.struct("hit_rate", F.col("k")[1])).alias("pattern")
    )
    return best.select(
        "column_name", names[F.col("column_name")].alias("name_class"), tag[F.col("column_name")].alias("tags"),
        F.when(F.col("hit_rate") >= min_rate, F.col("pattern")).alias("pattern"), F.round("hit_rate", 6).alias("hit_rate"),
    )


def scan_text(df: DataFrame, text: str, keys) -> DataFrame:
    """Occurrences of each pattern in the whole text of every row.

    The filter stops at the first hit of a text; only texts with a hit are
    counted through.
    """
    hit = F.lit(False)
    for rx in TEXT_PATTERNS.values():
        hit = hit | F.col(text).rlike(rx)
    counts = [F.regexp_count(text, F.lit(rx)).cast("bigint").alias(f"{n}_count") for n, rx in TEXT_PATTERNS.items()]
    return df.where(hit).select(*keys, *counts)


def redact(text) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for name, rx in TEXT_PATTERNS.items():
        out = F.regexp_replace(out, rx, f"[{name.upper()}]")
    return out


MASKS = {"member_id": hash_id, "ssn": mask_ssn, "phone": mask_phone, "email": mask_email}


def masked(df: DataFrame, masks=None) -> DataFrame:
    use = MASKS if masks is None else masks
    return df.withColumns({c: f(c) for c, f in use.items() if c in df.columns})


def deidentified(df: DataFrame, privileged: Column, ids=("member_id",), drop=("ssn", "phone", "email")) -> DataFrame:
    """Raw ids for privileged readers, hashes otherwise; other identifiers removed."""
    hashed = {c: F.when(privileged, F.col(c)).otherwise(hash_id(c)) for c in ids if c in df.columns}
    return df.withColumns(hashed).drop(*drop)


def is_masked(column: str) -> Column:
    c = F.col(column)
    return c.isNull() | c.rlike(r"^(X|\*|[0-9a-f]{64}$)") | c.contains("***")


def audit_complete(*columns) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return ok


# -- access audits ---------------------------------------------------------

PHI_WORDS = ("member_id", "ssn", "phone", "email", "address")
EXPORTS = ("EXPORT", "DOWNLOAD", "COPY")
ADMIN = ("CREATE", "DROP", "ALTER", "GRANT", "REVOKE")


def _since(as_of, days: int):
    return F.col("access_time") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))


def phi_access(logs: DataFrame, as_of, days: int = 30, words=PHI_WORDS) -> DataFrame:
    """Any identifier column was read, and recently: both conditions bind."""
    touched = F.lit(False)
    for w in words:
        touched = touched | F.col("accessed_columns").contains(w)
    return logs.where(touched & _since(as_of, days))


def exports(logs: DataFrame, as_of, days: int = 90) -> DataFrame:
    return logs.where(F.col("action_name").isin(*EXPORTS) & _since(as_of, days))


def admin_actions(logs: DataFrame, as_of, days: int = 30) -> DataFrame:
    return logs.where(F.col("action_name").isin(*ADMIN) & _since(as_of, days))


def suspicious_access(logs: DataFrame, bulk_rows: float = 10000, failures: int = 5) -> DataFrame:
    """Bulk reads, access at night and repeated failures per user."""
    hour = F.hour("access_time")
    return logs.groupBy("user_id").agg(
        F.count_if(F.col("rows_affected") > bulk_rows).alias("bulk_reads"),
        F.count_if((hour >= 22) | (hour < 6)).alias("night_accesses"),
        F.count_if(F.col("action_name") == "LOGIN_FAILED").alias("failed_logins"),
    ).withColumn("locked_candidate", F.col("failed_logins") >= failures)
