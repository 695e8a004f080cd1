"""Corrections as a fold of column transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.codes import present
from dqflow.functions.scalars import DATE_SHAPES, standardize_phone
from dqflow.operators.rules import RuleSet


def phones(df: DataFrame) -> dict[str, Column]:
    return {c: standardize_phone(c) for c in df.columns if "phone" in c.lower()}


def gender(c="gender") -> Column:
    up = F.upper(F.trim(F.col(c)))
    return F.when(up.isin("MALE", "M"), F.lit("M")).when(up.isin("FEMALE", "F"), F.lit("F")).otherwise(F.col(c))


def us_date(c) -> Column:
    """``MM/dd/yyyy`` text to ISO text; other text is left alone."""
    col = F.col(c)
    parsed = F.when(col.rlike(DATE_SHAPES["MM/dd/yyyy"]), F.try_to_date(col, "MM/dd/yyyy"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), col)


def incomplete(required) -> Column:
    """1 when any required field is NULL or blank."""
    missing = reduce(lambda a, b: a | b, [~present(c) for c in required])
    return F.when(missing, 1).otherwise(0)


def corrections(df: DataFrame, required=()) -> dict[str, Column]:
    out = dict(phones(df))
    for c in df.columns:
        if c.lower() == "gender":
            out[c] = gender(c)
        elif "date" in c.lower() and dict(df.dtypes)[c] == "string":
            out[c] = us_date(c)
    if required:
        out["_quality_incomplete"] = incomplete(required)
    return out


def remediate(df: DataFrame, rules: RuleSet, required=()) -> DataFrame:
    """Apply every remediation an enabled rule asks for, plus format corrections."""
    actions = {r.remediation_action for r in rules.rules.values() if r.enabled and r.auto_remediate}
    todo = corrections(df, required if "mark_incomplete" in actions else ())
    if "standardize_phone" not in actions:
        for c in phones(df):
            todo.pop(c, None)
    return df.withColumns(todo)


def remediation_log(df: DataFrame, rules: RuleSet, required=()) -> DataFrame:
    """Rows changed per corrected column, in the same pass that reads the data."""
    fixed = corrections(df, required)
    names = [c for c in fixed if c != "_quality_incomplete"]
    changed = [F.count_if(~F.col(c).eqNullSafe(fixed[c])).alias(f"c{i}") for i, c in enumerate(names)]
    flagged = F.count_if(fixed["_quality_incomplete"] == 1) if required else F.lit(0)
    wide = df.agg(*changed, flagged.cast("bigint").alias("flagged"))
    rows = [F.struct(F.lit(c).alias("target"), F.lit("corrected").alias("action"), F.col(f"c{i}").alias("rows_changed")) for i, c in enumerate(names)]
    rows.append(F.struct(F.lit("_quality_incomplete").alias("target"), F.lit("flagged").alias("action"), F.col("flagged").alias("rows_changed")))
    return wide.select(F.inline(F.array(*rows)))
