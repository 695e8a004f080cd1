"""Table expectations: warn, drop or quarantine, evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.scalars import is_true

ACTIONS = ("warn", "drop", "quarantine")


@dataclass(frozen=True)
class Expectation:
    """A row violates the expectation unless the predicate is TRUE."""

    name: str
    predicate: Column
    action: str = "warn"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")


def from_sql(conditions: dict, action: str = "warn") -> list[Expectation]:
    return [Expectation(n, F.expr(c), action) for n, c in conditions.items()]


def evaluate(df: DataFrame, expectations) -> DataFrame:
    """Add ``_failed``: names of all violated expectations."""
    marks = [F.when(~is_true(e.predicate), F.lit(e.name)) for e in expectations]
    return df.withColumn("_failed", F.array_compact(F.array(*marks)))


def _names(expectations, *actions):
    return F.array(*[F.lit(e.name) for e in expectations if e.action in actions]).cast("array<string>")


def passes(expectations) -> Column:
    return ~F.arrays_overlap("_failed", _names(expectations, "drop", "quarantine"))


def keep(df: DataFrame, expectations) -> DataFrame:
    """Rows that no drop or quarantine expectation rejects."""
    if not any(e.action in ("drop", "quarantine") for e in expectations):
        return df
    return evaluate(df, expectations).where(passes(expectations)).drop("_failed")


def split(df: DataFrame, expectations, as_of) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows; dropped rows are in neither.

    The two are complements over one evaluated column when no expectation
    drops rows.
    """
    marked = evaluate(df, expectations)
    quarantined = F.arrays_overlap("_failed", _names(expectations, "quarantine"))
    dropped = F.arrays_overlap("_failed", _names(expectations, "drop"))
    clean = marked.where(~quarantined & ~dropped).drop("_failed")
    bad = marked.where(quarantined & ~dropped).select(
        *df.columns,
        F.array_join(F.array_intersect("_failed", _names(expectations, "quarantine")), ",").alias("failed_expectation"),
        F.lit(as_of).alias("quarantine_timestamp"),
    )
    return clean, bad


def expectation_metrics(df: DataFrame, expectations) -> DataFrame:
    """Passed and failed rows per expectation from a single scan."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(e.predicate).alias(f"_p{i}") for i, e in enumerate(expectations)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(e.name).alias("expectation"),
                F.lit(e.action).alias("action"),
                F.col(f"_p{i}").alias("passed_records"),
                (F.col("_n") - F.col(f"_p{i}")).alias("failed_records"),
            )
            for i, e in enumerate(expectations)
        ]
    )
    return wide.select(F.inline(rows))


def observed(df: DataFrame, expectations, observation) -> DataFrame:
    """Attach pass counts to a write without a second pass over the data."""
    return df.observe(
        observation, F.count(F.lit(1)).alias("records"), *[F.count_if(e.predicate).alias(e.name) for e in expectations]
    )
