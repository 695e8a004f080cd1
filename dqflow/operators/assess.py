"""Rule assessment in one aggregation, and the scores derived from it.

Every bound (field, rule) pair becomes one ``count_if``; all of them share one
scan and one global aggregate.  Everything after that works on one row per
pair.  Exact uniqueness is the only part that shuffles data, keyed by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.functions.codes import COMPLETENESS_TARGETS, CRITICAL_FIELDS, EXPECTED_FIELDS, REQUIRED_FIELDS, present
from dqflow.operators.rules import DEFAULT_WEIGHT, DIMENSIONS, WEIGHTS, RuleSet, checked_predicate
from dqflow.sources.tables import stored_layer

CHUNK = 300

# Score thresholds as fractions.
THRESHOLDS = {"critical_quality_score": 0.60, "warning_quality_score": 0.80, "target_quality_score": 0.95}
# Critical / warning / target per measure.
BANDS = {
    "completeness": (0.70, 0.85, 0.95),
    "validity": (0.75, 0.90, 0.98),
    "consistency": (0.80, 0.92, 0.98),
    "accuracy": (0.85, 0.95, 0.99),
    "data_age_hours": (48, 24, 6),
    "duplicate_rate": (0.10, 0.05, 0.01),
    "volume_change": (0.50, 0.25, 0.10),
}
HIGHER_IS_WORSE = ("data_age_hours", "duplicate_rate", "volume_change")
# Good / fair bands of the dimension metrics, in percent or hours.
METRIC_BANDS = {
    "null_percentage": (5.0, 15.0, False),
    "blank_percentage": (3.0, 10.0, False),
    "format_compliance": (95.0, 85.0, True),
    "range_compliance": (98.0, 90.0, True),
    "cross_field_consistency": (95.0, 85.0, True),
    "reference_integrity": (99.0, 95.0, True),
    "business_rule_compliance": (96.0, 88.0, True),
    "data_freshness": (6.0, 24.0, False),
}


def one_pass(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """``(key, value, total)`` rows from many aggregates over a single scan.

    ``total`` is the number of rows, counted in the same pass.

    Beyond ``CHUNK`` measures the aggregate is cut so that each generated
    function stays compilable; each chunk scans once.
    """
    names = list(measures)
    parts = []
    for i in range(0, len(names), CHUNK):
        chunk = names[i : i + CHUNK]
        wide = df.agg(
            F.count(F.lit(1)).cast("double").alias("rows"), *[measures[n].cast("double").alias(f"m{j}") for j, n in enumerate(chunk)]
        )
        pairs = F.array(
            *[F.struct(F.lit(n).alias("key"), F.col(f"m{j}").alias("value"), F.col("rows").alias("total")) for j, n in enumerate(chunk)]
        )
        parts.append(wide.select(F.inline(pairs)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_counts(df: DataFrame, fields) -> DataFrame:
    """Exact distinct count per field, NULL being one value.

    Unpivoted to (field, value) so that the shuffle key contains the value and
    a frequent value is folded before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    values = df.select(F.inline(pairs)).groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("field").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("null_values"),
    )


def rule_results(df: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per (field, rule): counts, score 0-100 and the verdict."""
    bound = rules.bind(df.schema)
    counted, unique, broken, info = {}, [], [], {}
    for fname, rule in bound:
        key = f"{fname}\x1f{rule.name}"
        info[key] = (fname, rule)
        if rule.dimension == "uniqueness":
            unique.append((fname, rule))
            continue
        cond = checked_predicate(df, rule, fname)
        if cond is None:
            broken.append(key)
            cond = F.lit(False)
        counted[key] = F.count_if(cond)
    found = [one_pass(df, counted)] if counted else []
    if unique:
        d = distinct_counts(df, sorted({f for f, _ in unique}))
        names = F.create_map(*[x for f, r in unique for x in (F.lit(f), F.lit(f"{f}\x1f{r.name}"))])
        d = d.select(
            names[F.col("field")].alias("key"),
            F.when(F.col("distinct_values") == F.col("total"), F.col("total")).otherwise(0).cast("double").alias("value"),
            F.col("total").cast("double").alias("total"),
        )
        found.append(d)
    passes = reduce(lambda a, b: a.unionByName(b), found)

    meta = F.create_map(
        *[
            x
            for key, (fname, rule) in info.items()
            for x in (
                F.lit(key),
                F.struct(
                    F.lit(fname).alias("field"),
                    F.lit(rule.name).alias("rule"),
                    F.lit(rule.dimension).alias("dimension"),
                    F.lit(rule.severity).alias("severity"),
                    F.lit(rule.threshold).cast("double").alias("threshold"),
                    F.lit("condition does not analyse" if key in broken else None).cast("string").alias("error"),
                ),
            )
        ]
    )
    score = F.when(F.col("total") > 0, F.col("value") / F.col("total") * 100).otherwise(F.lit(0.0))
    out = passes.select(meta[F.col("key")].alias("m"), "value", "total", score.alias("score")).select("m.*", "value", "total", "score")
    violations = F.col("total") - F.col("value")
    return out.select(
        "field", "rule", "dimension", "severity",
        F.col("value").cast("bigint").alias("passed_count"),
        violations.cast("bigint").alias("violation_count"),
        F.col("total").cast("bigint").alias("total_count"),
        "score",
        ((violations == 0) | F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))).alias("passed"),
        "error",
    )


def settled_results(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rule results written once, for the several tables derived from them.

    One row per (field, rule) in the shared work folder; the assessed table is
    not read again, whatever is derived.
    """
    return stored_layer(rule_results(df, rules).coalesce(1), "rule-results")


def field_results(results: DataFrame) -> DataFrame:
    """Mean of rule scores per (field, dimension)."""
    return results.groupBy("field", "dimension").agg(F.avg("score").alias("score"))


def field_scores(results: DataFrame) -> DataFrame:
    return field_results(results).groupBy("field").agg(F.avg("score").alias("field_score"))


def field_nulls(results: DataFrame) -> DataFrame:
    """Null count and percentage per field, read off the null rule's violations."""
    return results.where("rule = 'null_completeness'").select(
        "field",
        F.col("violation_count").alias("null_count"),
        F.when(F.col("total_count") > 0, F.col("violation_count") / F.col("total_count") * 100)
        .otherwise(F.lit(0.0))
        .alias("null_percentage"),
    )


def dimension_scores(results: DataFrame) -> DataFrame:
    """One row per dimension; a dimension without rules scores 100."""
    means = field_results(results).groupBy().pivot("dimension", list(DIMENSIONS)).agg(F.avg("score"))
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit(100.0)).alias("score")) for d in DIMENSIONS]
    )
    return means.select(F.inline(pairs))


def overall_score(dimensions: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted mean of the dimensions; weights are normalised by their sum."""
    w = WEIGHTS if weights is None else weights
    table = F.create_map(*[F.lit(x) for d in DIMENSIONS for x in (d, float(w.get(d, DEFAULT_WEIGHT)))])
    weight = table[F.col("dimension")]
    return dimensions.agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("overall_score"))


def field_dimension_matrix(results: DataFrame) -> DataFrame:
    return field_results(results).groupBy("field").pivot("dimension", list(DIMENSIONS)).agg(F.first("score"))


def issues(results: DataFrame, thresholds: dict | None = None, weights: dict | None = None) -> DataFrame:
    """``(type, severity, field, measured)`` for everything below its threshold."""
    t = {**THRESHOLDS, **(thresholds or {})}
    dims = dimension_scores(results)
    s = F.col("overall_score")
    none = F.lit(None).cast("string")
    overall = (
        overall_score(dims, weights)
        .select(
            F.when(s < t["critical_quality_score"] * 100, F.lit("critical_overall_quality"))
            .when(s < t["warning_quality_score"] * 100, F.lit("low_overall_quality"))
            .alias("type"),
            F.when(s < t["critical_quality_score"] * 100, F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
            none.alias("field"),
            s.alias("measured"),
        )
        .where("type IS NOT NULL")
    )
    low = dims.where("score < 70").select(
        F.concat(F.lit("low_"), "dimension", F.lit("_score")).alias("type"),
        F.lit("critical").alias("severity"),
        none.alias("field"),
        F.col("score").alias("measured"),
    )
    nulls = field_nulls(results).where("null_percentage > 20").select(
        F.lit("high_null_percentage").alias("type"),
        F.lit("warning").alias("severity"),
        "field",
        F.col("null_percentage").alias("measured"),
    )
    return overall.unionByName(low).unionByName(nulls)


# Advice by condition on the scores.
ADVICE = (
    ("overall", 85, "Implement comprehensive data quality monitoring"),
    ("overall", 85, "Establish data quality SLAs and accountability"),
    ("completeness", 90, "Improve data collection processes to reduce missing values"),
    ("completeness", 90, "Implement data validation at source systems"),
    ("validity", 85, "Enhance format validation and standardization"),
    ("validity", 85, "Implement real-time data validation rules"),
    ("consistency", 90, "Establish master data management practices"),
    ("consistency", 90, "Implement cross-system data reconciliation"),
)
#: Advice where a coded field has an issue.
CODE_ADVICE = (
    "Check code fields against their formats when they enter",
    "Verify provider numbers by their check digit before claims are accepted",
    "Keep provider records current: status, license and taxonomy",
)
CODE_WORDS = "npi|icd|cpt|member|provider"


def recommendations(results: DataFrame, weights: dict | None = None) -> DataFrame:
    """Ordered advice rows; code advice when an issue touches a coded field."""
    dims = dimension_scores(results)
    scores = dims.unionByName(overall_score(dims, weights).select(F.lit("overall").alias("dimension"), F.col("overall_score").alias("score")))
    advice = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(d).alias("d"), F.lit(float(b)).alias("below"), F.lit(text).alias("recommendation"))
            for i, (d, b, text) in enumerate(ADVICE)
        ]
    )
    general = (
        scores.select("dimension", "score", F.inline(advice))
        .where((F.col("dimension") == F.col("d")) & (F.col("score") < F.col("below")))
        .select("position", "recommendation")
    )
    coded = issues(results, weights=weights).where(F.lower(F.coalesce("field", "type")).rlike(CODE_WORDS)).agg(F.count("*").alias("n"))
    extra = F.array(
        *[F.struct(F.lit(len(ADVICE) + i).alias("position"), F.lit(t).alias("recommendation")) for i, t in enumerate(CODE_ADVICE)]
    )
    return general.unionByName(coded.where("n > 0").select(F.inline(extra)))


def required_presence(df: DataFrame, entity: str, conditional=()) -> DataFrame:
    """entity, field, target, completeness and ``meets_target`` of an entity's required fields, in one pass.

    Critical fields aim at 100 %, ``conditional`` ones at 98 %, all others at 95 %.  Blank text counts as missing.
    """
    fields, n = REQUIRED_FIELDS[entity], F.count(F.lit(1))
    kind = {f: "critical" if f in CRITICAL_FIELDS else "conditional" if f in conditional else "required" for f in fields}
    there = [(F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")) * 100.0 / n).alias(f) for f in fields]
    rows = [F.struct(F.lit(f).alias("field"), F.lit(COMPLETENESS_TARGETS[kind[f]]).alias("target"), F.round(f, 6).alias("completeness")) for f in fields]
    return df.agg(*there).select(F.lit(entity).alias("entity"), F.inline(F.array(*rows))).withColumn("meets_target", F.col("completeness") >= F.col("target"))


def assess(df: DataFrame, table: str, rules: RuleSet, custom=None, weights=None, thresholds=None) -> dict[str, DataFrame]:
    """All result tables of one assessment, derived from one set of counts."""
    results = settled_results(df, rules.with_rules(custom))
    dims = dimension_scores(results)
    return {
        "rules": results.withColumn("table_name", F.lit(table)),
        "fields": field_scores(results).join(field_nulls(results), "field", "left"),
        "dimensions": dims,
        "overall": overall_score(dims, weights).withColumn("table_name", F.lit(table)),
        "issues": issues(results, thresholds, weights),
        "recommendations": recommendations(results, weights),
    }


def summary_row(df: DataFrame, table: str, rules: RuleSet, custom=None) -> DataFrame:
    """One row per table: counts, scores, failed rules and critical issues."""
    results = settled_results(df, rules.with_rules(custom))
    dims = dimension_scores(results)
    wide = dims.groupBy().pivot("dimension", list(DIMENSIONS)).agg(F.first("score"))
    tally = results.agg(
        F.max("total_count").alias("record_count"),
        F.countDistinct("field").alias("field_count"),
        F.count("*").alias("rule_count"),
        F.count_if(~F.col("passed")).alias("failed_rules"),
    )
    critical = issues(results).agg(F.count_if(F.col("severity") == "critical").alias("n")).scalar()
    overall = overall_score(dims).scalar()
    return (
        tally.withColumns({"overall_score": overall, "critical_issues": critical, "table_name": F.lit(table)})
        .withColumns({d: wide.select(d).scalar() for d in DIMENSIONS})
    )


def as_document(tables: dict[str, DataFrame]) -> dict:
    """Plain-Python view of the (rule-sized) result tables for JSON or YAML export."""
    return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}


def band(measure: str, value: Column) -> Column:
    critical, warning, target = BANDS[measure]
    if measure in HIGHER_IS_WORSE:
        return (
            F.when(value > critical, F.lit("critical")).when(value > warning, F.lit("warning"))
            .when(value > target, F.lit("acceptable")).otherwise(F.lit("target"))
        )
    return (
        F.when(value < critical, F.lit("critical")).when(value < warning, F.lit("warning"))
        .when(value < target, F.lit("acceptable")).otherwise(F.lit("target"))
    )


def metric_band(metric: str, value: Column) -> Column:
    good, fair, higher = METRIC_BANDS[metric]
    if higher:
        return F.when(value > good, F.lit("good")).when(value > fair, F.lit("fair")).otherwise(F.lit("poor"))
    return F.when(value < good, F.lit("good")).when(value < fair, F.lit("fair")).otherwise(F.lit("poor"))


def completeness_targets(df: DataFrame) -> DataFrame:
    """Share of present values per critical and required field against its target."""
    kinds = {**{f: "critical" for f in CRITICAL_FIELDS}, **{f: "required" for f in EXPECTED_FIELDS}}
    fields = [f for f in kinds if f in df.columns]
    raw = one_pass(df, {f: F.count_if(present(f)) for f in fields})
    table = F.create_map(
        *[x for f in fields for x in (F.lit(f), F.struct(F.lit(kinds[f]).alias("kind"), F.lit(COMPLETENESS_TARGETS[kinds[f]]).alias("target")))]
    )
    share = F.col("value") * 100 / F.col("total")
    return (
        raw.withColumns({"t": table[F.col("key")], "share": share})
        .select(
            F.col("key").alias("field"), "t.kind", "t.target", F.round("share", 6).alias("completeness"),
            (F.col("share") >= F.col("t.target")).alias("meets_target"),
        )
    )
