"""Statistical, temporal and domain anomaly detectors.

Every detector returns rows of one schema: id, type, severity, field, score
0-10, affected records, threshold, method, context and recommendations.  Ids
hash (table, field, method, detail), so repeated runs agree.
"""

from __future__ import annotations

import itertools

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqflow.operators.assess import one_pass
from dqflow.operators.profile import numeric_fields
from dqflow.operators.quantiles import exact_percentiles
from dqflow.operators.skew import attach_stats
from dqflow.sources.tables import stored_layer

#: What to look at first when a method reports something.
RECOMMENDATIONS = {
    "z_score": ("Look up the rows far from the mean and where they were keyed in", "Keep them if they are real: a few large values may be the business"),
    "iqr": ("Compare the rows outside the fences with the rest by source", "A long tail may call for a logarithm before fences are drawn"),
    "volume_change": ("See which feeds delivered more or fewer rows in this hour", "Look for repeated or missing files around it"),
    "seasonal_analysis": ("Compare with the same hour of other weeks", "Holidays and one-off loads shift the hourly baseline"),
    "zero_claims_analysis": ("List zero amounts by provider and claim type", "See whether the amount was lost on the way in"),
    "high_claims_analysis": ("Hold the largest claims against others of the same procedure", "A shifted decimal point shows as a factor of ten or a hundred"),
    "utilization_analysis": ("Read the claim history of the busiest members", "Rule out repeated submissions before suspecting misuse"),
    "provider_shopping_analysis": ("See how many providers billed one member for one condition", "Shared practices may explain several identifiers"),
    "high_cost_analysis": ("Split the total of each costly member by procedure",),
    "isolation_forest": ("Read the highest scores with all their fields side by side", "Odd combinations of usual values are what this method finds"),
    "dbscan": ("Plot the rows outside all clusters", "Try a wider radius if whole regions are reported"),
}
STATISTICAL, TEMPORAL, VOLUME = "statistical_outlier", "temporal_anomaly", "volume_anomaly"
DOMAIN, MULTIVARIATE = "healthcare_specific", "multivariate_anomaly"
MIN_SAMPLE = 100


def anomaly_rows(df: DataFrame, table: str, kind: str, method: str, field: Column, severity: Column, score: Column,
                 affected: Column, threshold: float, context: dict, detail: Column | None = None) -> DataFrame:
    ctx = F.create_map(*[x for k, v in context.items() for x in (F.lit(k), v.cast("double"))])
    ident = F.sha2(F.concat_ws("|", F.lit(table), field, F.lit(method), detail if detail is not None else F.lit("")), 256)
    return df.select(
        ident.alias("anomaly_id"),
        F.lit(kind).alias("anomaly_type"),
        severity.alias("severity"),
        field.alias("field_name"),
        score.cast("double").alias("score"),
        affected.cast("bigint").alias("affected_records"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(method).alias("detection_method"),
        ctx.alias("context"),
        F.array(*[F.lit(r) for r in RECOMMENDATIONS[method]]).alias("recommendations"),
    )


def banded(value: Column, critical, high, medium) -> Column:
    return (
        F.when(value > critical, F.lit("critical")).when(value > high, F.lit("high")).when(value > medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# -- statistical -----------------------------------------------------------

def _moments(df: DataFrame, fields) -> Column:
    """Scalar struct with mean, deviation and count of every field."""
    cols = []
    for f in fields:
        x = F.col(f).cast("double")
        cols.append(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n")).alias(f))
    return df.agg(*cols).select(F.struct(*fields)).scalar()


def z_score(df: DataFrame, table: str, fields=None, threshold: float = 3.0, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Values more than ``threshold`` deviations from the mean, all fields in two scans."""
    fields = list(fields or numeric_fields(df))
    stats = _moments(df, fields)
    outlier = {f: F.count_if(F.abs((F.col(f).cast("double") - F.col("_s")[f]["mean"]) / F.col("_s")[f]["sd"]) > threshold) for f in fields}
    counts = one_pass(df.withColumn("_s", stats), outlier).withColumn("_s", stats)
    by_name = F.create_map(*[x for f in fields for x in (F.lit(f), F.col("_s")[f])])
    rows = counts.select(F.col("key").alias("f"), F.col("value").alias("k"), by_name[F.col("key")].alias("s")).where(
        (F.col("k") > 0) & (F.col("s.sd") > 0) & (F.col("s.n") >= min_sample)
    )
    pct = F.col("k") / F.col("s.n") * 100
    return anomaly_rows(
        rows, table, STATISTICAL, "z_score", F.col("f"), banded(pct, 10, 5, 1), pct / 10, F.col("k"), threshold,
        {"mean": F.col("s.mean"), "stddev": F.col("s.sd"), "outlier_percentage": pct},
    )


def iqr(df: DataFrame, table: str, fields=None, multiplier: float = 1.5) -> DataFrame:
    """Values outside the quartile fences; exact quartiles of all fields at once."""
    fields = list(fields or numeric_fields(df))
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("x")) for f in fields])
    long = df.select(F.inline(pairs)).where("x IS NOT NULL")
    q = exact_percentiles(long, "f", "x", {"q1": 0.25, "q3": 0.75})
    # One entry per field: the fences travel as a scalar, the table is scanned once more.
    fences = q.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("q1", "q3", F.col("_n").alias("n")))))).scalar()
    s = F.col("_q")
    counted = {}
    for f in fields:
        lo, hi = s[f]["q1"], s[f]["q3"]
        x = F.col(f).cast("double")
        counted[f] = F.count_if((x < lo - multiplier * (hi - lo)) | (x > hi + multiplier * (hi - lo)))
    counts = one_pass(df.withColumn("_q", fences), counted).withColumn("_q", fences)
    rows = counts.select(F.col("key").alias("f"), F.col("value").alias("k"), s[F.col("key")].alias("s")).where("k > 0")
    spread = F.col("s.q3") - F.col("s.q1")
    pct = F.col("k") / F.col("s.n") * 100
    return anomaly_rows(
        rows, table, STATISTICAL, "iqr", F.col("f"), banded(pct, 15, 8, 3), F.least(F.lit(10.0), pct / 2), F.col("k"), multiplier,
        {
            "q1": F.col("s.q1"), "q3": F.col("s.q3"), "iqr": spread,
            "lower_bound": F.col("s.q1") - multiplier * spread, "upper_bound": F.col("s.q3") + multiplier * spread,
            "outlier_percentage": pct,
        },
    )


# -- temporal --------------------------------------------------------------

def hourly_change(df: DataFrame, ts: str) -> DataFrame:
    """Volume per non-empty hour and its relative change; the window orders hours only."""
    hours = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count(F.lit(1)).alias("volume"))
    hours = hours.where("hour IS NOT NULL").withColumn("previous", F.lag("volume").over(W.orderBy("hour")))
    change = F.when(F.col("previous") > 0, F.abs(F.col("volume") - F.col("previous")) / F.col("previous")).otherwise(F.lit(0.0))
    return hours.withColumn("change", change)


def volume_change(df: DataFrame, table: str, ts: str, threshold: float = 0.5) -> DataFrame:
    rows = hourly_change(df, ts).where(F.col("change") > threshold)
    c = F.col("change")
    return anomaly_rows(
        rows, table, VOLUME, "volume_change", F.lit("record_volume"), banded(c, 0.8, 0.6, 0.4), F.least(F.lit(10.0), c * 10),
        F.col("volume"), threshold,
        {
            "current_volume": F.col("volume"), "previous_volume": F.col("previous"), "change_percentage": c,
            "increase": (F.col("volume") > F.col("previous")).cast("int"),
        },
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss"),
    )


def seasonal_scores(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Deviation of every row from the mean of its hour and weekday.

    The 168 baselines are one small aggregate; a fixed number of rows, so it is
    joined by broadcast and no (hour, weekday) group is ever gathered.
    """
    x = F.col(value).cast("double")
    rows = df.withColumns({"_h": F.hour(ts), "_d": F.dayofweek(ts)})
    base = rows.groupBy("_h", "_d").agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"))
    z = F.when(F.col("_sd") > 0, F.abs(x - F.col("_mean")) / F.col("_sd"))
    return rows.join(F.broadcast(base), ["_h", "_d"], "left").withColumn("seasonal_z", z).drop("_h", "_d", "_mean", "_sd")


def seasonal(df: DataFrame, table: str, ts: str, value: str, limit: float = 2.5, period: int = 24) -> DataFrame:
    z = F.col("seasonal_z")
    agg = seasonal_scores(df, ts, value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(z > limit).alias("k"), F.avg(F.when(z > limit, z)).alias("dev")
    )
    pct = F.col("k") / F.col("n") * 100
    dev = F.col("dev")
    severity = (
        F.when((dev > 5) | (pct > 10), F.lit("high")).when((dev > 3) | (pct > 5), F.lit("medium")).otherwise(F.lit("low"))
    )
    return anomaly_rows(
        agg.where("k > 0"), table, TEMPORAL, "seasonal_analysis", F.lit(value), severity, F.least(F.lit(10.0), dev), F.col("k"), limit,
        {"anomaly_count": F.col("k"), "anomaly_percentage": pct, "avg_deviation": dev, "seasonal_period": F.lit(period)},
    )


# -- domain ----------------------------------------------------------------

def zero_amount(df: DataFrame, table: str, limit: float = 5.0) -> DataFrame:
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("claim_amount") == 0).alias("k"))
    pct = F.col("k") / F.col("n") * 100
    return anomaly_rows(
        agg.where(pct > limit), table, DOMAIN, "zero_claims_analysis", F.lit("claim_amount"), F.lit("high"),
        F.least(F.lit(10.0), pct / 2), F.col("k"), limit,
        {"zero_claims_count": F.col("k"), "zero_claims_percentage": pct, "total_claims": F.col("n")},
    )


def high_amount(df: DataFrame, table: str, limit: float = 1.0, sigmas: float = 3.0, min_claims: int = 10) -> DataFrame:
    """Amounts above mean plus three deviations of their procedure."""
    x = F.col("claim_amount").cast("double")
    rows = attach_stats(
        df.select("procedure_code", "claim_amount"), "procedure_code",
        [F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count("claim_amount").alias("c")], few=True,
    )
    high = (F.col("c") >= min_claims) & (F.col("s") > 0) & (x > F.col("m") + sigmas * F.col("s"))
    agg = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("k"))
    pct = F.col("k") / F.col("n") * 100
    return anomaly_rows(
        agg.where(pct > limit), table, DOMAIN, "high_claims_analysis", F.lit("claim_amount"), F.lit("medium"),
        F.least(F.lit(10.0), pct * 2), F.col("k"), sigmas,
        {"high_claims_count": F.col("k"), "high_claims_percentage": pct, "total_claims": F.col("n")},
    )


def member_profile(df: DataFrame) -> DataFrame:
    """Claims, spend and distinct providers per member.

    Folding to (member, provider) first keeps the distinct count to one
    shuffle whose key spreads a member's rows.
    """
    pairs = df.groupBy("member_id", "provider_npi").agg(
        F.count("claim_id").alias("_c"), F.sum("claim_amount").alias("_a")
    )
    return pairs.groupBy("member_id").agg(
        F.sum("_c").alias("claim_count"), F.sum("_a").alias("total_amount"), F.count("provider_npi").alias("provider_count")
    )


def utilization(df: DataFrame, table: str) -> DataFrame:
    """Excessive use, provider shopping and high cost as shares of all members."""
    agg = member_profile(df).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("claim_count") > 50).alias("u"),
        F.count_if(F.col("provider_count") > 10).alias("p"),
        F.count_if(F.col("total_amount") > 50000).alias("c"),
    )

    def part(k, limit, method, field, severity, factor, threshold):
        pct = F.col(k) / F.col("n") * 100
        return anomaly_rows(
            agg.where((F.col(k) > 0) & (pct > limit)), table, DOMAIN, method, F.lit(field), F.lit(severity),
            F.least(F.lit(10.0), pct * factor), F.col(k), threshold,
            {"count": F.col(k), "percentage": pct, "total_members": F.col("n")},
        )

    return union_all(
        [
            part("u", 2, "utilization_analysis", "member_utilization", "high", 1, 50),
            part("p", 1, "provider_shopping_analysis", "provider_utilization", "medium", 2, 10),
            part("c", 1, "high_cost_analysis", "member_cost", "medium", 1, 50000),
        ]
    )


# Column names that mark a domain table.
DOMAIN_NAMES = ("claim", "member", "patient", "provider")
DOMAIN_FIELDS = (
    "member_id", "patient_id", "claim_id", "provider_npi", "diagnosis_code", "procedure_code", "icd", "cpt", "hcpcs", "claim_amount",
)


def is_domain_table(table: str, fields) -> bool:
    if any(n in table.lower() for n in DOMAIN_NAMES):
        return True
    return sum(any(i in f.lower() for i in DOMAIN_FIELDS) for f in fields) >= 3


#: Most fields of one density grid.
GRID_FIELDS = 3


def detect_all(df: DataFrame, table: str, ts: str | None = None, multivariate: bool = True, fields=None) -> DataFrame:
    """All detectors that apply to the table, one row per finding.

    ``fields`` are the numeric columns to examine, all of them by default; ``field_name`` of a finding names those used.
    """
    numbers = numeric_fields(df) if fields is None else list(fields)
    found = []
    if numbers:
        found += [z_score(df, table, numbers), iqr(df, table, numbers)]
    if ts and ts in df.columns:
        found.append(volume_change(df, table, ts))
        found += [seasonal(df, table, ts, f) for f in numbers]
    needed = {"procedure_code", "claim_amount", "member_id", "provider_npi", "claim_id"}
    if is_domain_table(table, df.columns) and needed <= set(df.columns):
        found += [zero_amount(df, table), high_amount(df, table), utilization(df, table)]
    if multivariate and len(numbers) >= 2:
        from dqflow.operators.multivariate import dbscan_anomalies, forest_anomalies

        found.append(forest_anomalies(df, table, numbers))
        if len(numbers) <= GRID_FIELDS:
            found.append(dbscan_anomalies(df, table, numbers))
        else:
            # The grid's neighbourhood grows with the power of the fields: every pair of fields is examined instead.
            found += [dbscan_anomalies(df, table, list(p)) for p in itertools.combinations(numbers, 2)]
    return union_all(found)


def volume_bands(df: DataFrame, day: Column, trailing: int = 7) -> DataFrame:
    """Daily rows against the mean of the days before: critical, warning, expected."""
    daily = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("records")).where("day IS NOT NULL")
    before = W.orderBy("day").rowsBetween(-trailing, -1)
    base = F.sum("records").over(before) / F.count("records").over(before)
    c = F.abs(F.col("records") - F.col("baseline")) / F.col("baseline")
    return daily.withColumn("baseline", base).withColumn("change", c).withColumn(
        "band",
        F.when(F.col("baseline").isNull(), F.lit("no_baseline")).when(c > 0.5, F.lit("critical")).when(c > 0.25, F.lit("warning"))
        .when(c > 0.1, F.lit("unusual")).otherwise(F.lit("expected")),
    )


# -- reports over findings -------------------------------------------------

SEVERITY_ORDER = ("critical", "high", "medium", "low")


def severity_rank(c="severity") -> Column:
    out = F.lit(len(SEVERITY_ORDER))
    for i, s in reversed(list(enumerate(SEVERITY_ORDER))):
        out = F.when(F.col(c) == s, F.lit(i)).otherwise(out)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """Counts by type and by severity."""
    kinds = F.array(
        F.struct(F.lit("type").alias("grouping"), F.col("anomaly_type").alias("name")),
        F.struct(F.lit("severity").alias("grouping"), F.col("severity").alias("name")),
        F.struct(F.lit("all").alias("grouping"), F.lit("total").alias("name")),
    )
    return findings.select(F.inline(kinds), "affected_records").groupBy("grouping", "name").agg(
        F.count(F.lit(1)).alias("anomalies"), F.sum("affected_records").alias("affected_records")
    )


def top_findings(findings: DataFrame, k: int = 20) -> DataFrame:
    return findings.orderBy(severity_rank(), F.desc("score"), "anomaly_id").limit(k)


def report(findings: DataFrame, k: int = 20) -> DataFrame:
    """Findings as one long table: counts by severity and type, the first ``k`` findings, advice of every method met.

    Findings are one row per detector and field (or hour); they are written once for the four parts.
    """
    found = stored_layer(findings, "findings")

    def counts(column):
        return found.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(f"by {column}").alias("section"), "name", F.lit(None).cast("int").alias("position"), "value")

    first = found.orderBy(severity_rank(), F.desc("affected_records"), "anomaly_id").limit(k)
    place = F.row_number().over(W.orderBy(severity_rank(), F.desc("affected_records"), "anomaly_id"))
    top = first.select(
        F.lit("top").alias("section"), F.concat_ws(" ", "severity", "detection_method", "field_name").alias("name"),
        place.alias("position"), F.col("affected_records").alias("value"))
    advice = found.select("detection_method", F.posexplode("recommendations").alias("position", "name")).groupBy("name").agg(
        F.max("position").alias("position"), F.count(F.lit(1)).alias("value")).select(
        F.lit("advice").alias("section"), "name", (F.col("position") + 1).cast("int").alias("position"), "value")
    return counts("severity").unionByName(counts("anomaly_type")).unionByName(top).unionByName(advice)


def report_rollup(findings: DataFrame, total_records: Column) -> DataFrame:
    """Rate per record with counts by severity and type."""
    return findings.groupBy("anomaly_type", "severity").agg(
        F.count(F.lit(1)).alias("anomalies"), F.sum("affected_records").alias("affected_records")
    ).withColumn("rate_percentage", F.col("anomalies") / total_records * 100)


def report_text(findings: DataFrame, table: str, k: int = 20) -> str:
    """Plain-text report from the summary and at most ``k`` findings."""
    lines = [f"Anomaly report: {table}"]
    for r in summary(findings).orderBy("grouping", "name").collect():
        lines.append(f"  {r['grouping']} {r['name']}: {r['anomalies']}")
    for i, r in enumerate(top_findings(findings, k).collect(), 1):
        lines.append(
            f"{i}. [{r['severity']}] {r['field_name']} by {r['detection_method']}: "
            f"{r['affected_records']} records, score {r['score']:.2f}"
        )
        lines += [f"   - {x}" for x in r["recommendations"]]
    return "\n".join(lines)
