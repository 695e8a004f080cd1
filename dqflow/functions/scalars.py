"""Small reusable column expressions: strings, dates, masks and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")
# The text shape each layout must have before it is parsed.
DATE_SHAPES = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c) -> Column:
    return F.regexp_replace(col_of(c), r"[^0-9]", "")


def is_true(c: Column) -> Column:
    """Three-valued logic folded to two: NULL counts as a violation."""
    return F.coalesce(c, F.lit(False))


def parse_date(c) -> Column:
    text = F.trim(col_of(c).cast("string"))
    tries = [F.when(text.rlike(DATE_SHAPES[f]), F.try_to_date(text, f)) for f in DATE_FORMATS]
    return F.coalesce(*tries)


def standardize_phone(c) -> Column:
    """Ten digits when the text holds a North American number, else unchanged."""
    c = col_of(c)
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d).otherwise(c)


def mask_ssn(c) -> Column:
    return F.concat(F.lit("XXX-XX-"), F.right(digits(c), F.lit(4)))


def mask_phone(c) -> Column:
    return F.concat(F.lit("XXX-XXX-"), F.right(digits(c), F.lit(4)))


def mask_email(c) -> Column:
    c = col_of(c)
    return F.when(
        c.contains("@"),
        F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1)),
    )


def hash_id(c) -> Column:
    return F.sha2(col_of(c).cast("string"), 256)


def freshness_hours(ts, as_of) -> Column:
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz")) - F.unix_timestamp(col_of(ts).cast("timestamp_ntz"))
    return seconds / F.lit(3600.0)


def char_class(c) -> Column:
    """isdigit, isalnum, isupper and islower as one struct of booleans."""
    c = col_of(c)
    return F.struct(
        c.rlike("^[0-9]+$").alias("is_digit"),
        c.rlike("^[A-Za-z0-9]+$").alias("is_alnum"),
        ((F.upper(c) == c) & c.rlike("[A-Za-z]")).alias("is_upper"),
        ((F.lower(c) == c) & c.rlike("[A-Za-z]")).alias("is_lower"),
    )


def rate(numerator: Column, denominator: Column, digits_: int = 6) -> Column:
    """Percentage rounded, zero for an empty denominator."""
    return F.round(
        F.when(denominator > 0, numerator.cast("double") / denominator * 100).otherwise(F.lit(0.0)), digits_
    )
