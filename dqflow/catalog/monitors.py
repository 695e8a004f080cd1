"""Registered queries: drift monitors, privacy, compliance and reports (MO, PR, QA21, RP, JN17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import add_view, query
from dqflow.operators import drift as D
from dqflow.operators import privacy as P
from dqflow.operators import reports as R

HALF = dt.date(2024, 1, 16)


def halves(spark, d):
    ev = S.events(spark, d)
    cut = F.lit(HALF).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def _profile(g):
    return f"""
SELECT '{g}' AS granularity, strftime(date_trunc('{g}', ts), '%Y-%m-%d') AS window_start, 'value' AS column_name, count(*) AS records, count(*) - count(value) AS null_count, count(DISTINCT value) AS distinct_count,
  round(avg(value), 1) AS mean, round(stddev_samp(value), 2) AS stddev, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 2
UNION ALL SELECT '{g}', strftime(date_trunc('{g}', ts), '%Y-%m-%d'), 'event_type', count(*), count(*) - count(event_type), count(DISTINCT event_type), NULL, NULL, NULL, NULL FROM events GROUP BY 2"""


@query("mo01_window_profile", _profile("day") + " UNION ALL " + _profile("week"))
def mo01(spark, d):
    parts = [
        D.window_profile(S.events(spark, d), "ts", g, ["value"], ["event_type"]).withColumn("granularity", F.lit(g)) for g in ("day", "week")
    ]
    return parts[0].unionByName(parts[1]).select(
        "granularity", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "column_name", "records", "null_count", "distinct_count",
        F.round("mean", 1).alias("mean"), F.round("stddev", 2).alias("stddev"), "min_value", "max_value",
    )


@query("mo02_window_volume", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS records, sum(length(event_id::varchar) + length(event_type) + length(props))::bigint AS bytes FROM events GROUP BY 1""")
def mo02(spark, d):
    ev = S.events(spark, d).select("ts", "event_id", "event_type", "props")
    out = D.window_volume(ev.withColumn("w", F.col("ts")).select("w", "event_id", "event_type", "props").withColumnRenamed("w", "ts"), "ts", "day")
    # The timestamp's own text width differs by engine; take it out of the estimate.
    own = S.events(spark, d).groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.sum(F.length(F.col("ts").cast("string"))).alias("t"))
    return out.join(own, "window_start").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "records", (F.col("bytes") - F.col("t")).alias("bytes"))


add_view("drift_scores", f"""
SELECT column_name, sqrt(greatest(js, 0)) AS drift_score, greatest(js, 0) AS js_divergence FROM (
SELECT column_name, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM (
SELECT column_name, bin, sum((side = 0)::int) / any_value(tb)::double AS p, sum((side = 1)::int) / any_value(tc)::double AS q FROM (
  SELECT *, sum((side = 0)::int) OVER (PARTITION BY column_name) AS tb, sum((side = 1)::int) OVER (PARTITION BY column_name) AS tc FROM (
  SELECT 'value' AS column_name, least(floor((value - lo) / (hi - lo) * 10), 9)::int::varchar AS bin, (ts >= DATE '{HALF}')::int AS side FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)
  UNION ALL SELECT 'event_type', event_type, (ts >= DATE '{HALF}')::int FROM events
  UNION ALL SELECT 'user_id', least(floor((user_id - lo) / (hi - lo)::double * 10), 9)::int::varchar, (ts >= DATE '{HALF}')::int FROM events, (SELECT min(user_id) AS lo, max(user_id) AS hi FROM events)))
GROUP BY 1, 2) GROUP BY 1)""")


def scores(spark, d):
    return D.drift(*halves(spark, d), numeric=["value", "user_id"], categorical=["event_type"])


@query("mo03_js_drift", "SELECT column_name, round(js_divergence, 6) AS js_divergence, round(drift_score, 6) AS drift_score FROM drift_scores")
def mo03(spark, d):
    return scores(spark, d).select("column_name", F.round("js_divergence", 6).alias("js_divergence"), F.round("drift_score", 6).alias("drift_score"))


add_view("daily_drift", """
WITH h AS (SELECT date_trunc('day', ts)::date AS w, least(floor((value - lo) / (hi - lo) * 10), 9)::int AS bin, count(*) AS c FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1, 2),
t AS (SELECT w, sum(c) AS t FROM h GROUP BY 1), days AS (SELECT a.w, a.t AS tc, b.t AS tp FROM t a JOIN t b ON b.w = a.w - 1),
g AS (SELECT days.w, bins.bin, coalesce(c.c, 0) / tc::double AS q, coalesce(p.c, 0) / tp::double AS p FROM days CROSS JOIN (SELECT unnest(range(10)) AS bin) bins
  LEFT JOIN h c ON c.w = days.w AND c.bin = bins.bin LEFT JOIN h p ON p.w = days.w - 1 AND p.bin = bins.bin)
SELECT w, greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0) AS js FROM g GROUP BY 1""")


@query("jn17_window_drift", "SELECT strftime(w, '%Y-%m-%d') AS window_start, round(js, 6) AS js_divergence FROM daily_drift")
def jn17(spark, d):
    out = D.windowed_drift(S.events(spark, d), "ts", "day", "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.round("js_divergence", 6).alias("js_divergence"))


@query("mo04_drift_alerts", """
SELECT strftime(w, '%Y-%m-%d') AS window_start, CASE WHEN sqrt(js) > .5 THEN 'high' WHEN sqrt(js) > .3 THEN 'medium' ELSE 'low' END AS severity FROM daily_drift WHERE sqrt(js) > .05""")
def mo04(spark, d):
    out = D.drift_alerts(D.windowed_drift(S.events(spark, d), "ts", "day", "value"), 0.05)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "severity")


@query("mo05_monitor_summary", """
SELECT count(*) AS columns, round(avg(drift_score), 6) AS avg_drift, round(max(drift_score), 6) AS max_drift, count(*) FILTER (WHERE drift_score > .1) AS drifted, count(*) FILTER (WHERE drift_score > .5) AS high_drift, 0.0::double AS avg_null_percentage FROM drift_scores""")
def mo05(spark, d):
    nulls = D.window_profile(S.events(spark, d), "ts", "week", ["value"], ["event_type"])
    return D.monitor_summary(scores(spark, d), nulls).withColumns({c: F.round(c, 6) for c in ("avg_drift", "max_drift", "avg_null_percentage")})


_HITS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{p}' AS pattern, coalesce(count(*) FILTER (WHERE regexp_matches({c}, '{rx}'))::double / nullif(count({c}), 0), 0) AS hit_rate FROM members"
    for c in ("member_id", "last_name", "gender", "phone", "email", "ssn", "zip_code", "state", "plan_type") for p, rx in P.VALUE_PATTERNS.items()
)
_NAMED = {c: (P.name_class(c) or "none", ",".join(P.tags(c))) for c in ("member_id", "last_name", "gender", "phone", "email", "ssn", "zip_code", "state", "plan_type")}
_NAMES = ", ".join(f"('{c}', '{a}', '{b}')" for c, (a, b) in _NAMED.items())


@query("mo06_column_classes", f"""
SELECT column_name, name_class, tags, CASE WHEN r >= .2 THEN pattern END AS pattern, round(r, 6) AS hit_rate FROM (
SELECT column_name, max(hit_rate) AS r, arg_max(pattern, (hit_rate, pattern)) AS pattern FROM ({_HITS}) GROUP BY 1) JOIN (VALUES {_NAMES}) n(column_name, name_class, tags) USING (column_name)""")
def mo06(spark, d):
    return P.classify_columns(S.members(spark, d))


@query("mo07_dashboard", """
SELECT 'metric' AS part, strftime(date_trunc('day', ts), '%Y-%m-%d') AS at, count(*)::double AS value FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 2
UNION ALL SELECT 'drift', strftime(w, '%Y-%m-%d'), round(js, 6) FROM daily_drift WHERE w >= DATE '2024-01-24'
UNION ALL SELECT 'alert', strftime(w, '%Y-%m-%d'), round(sqrt(js), 6) FROM daily_drift WHERE w >= DATE '2024-01-24' AND sqrt(js) > .05""")
def mo07(spark, d):
    """Volume, drift and alerts of the last week in one long table."""
    since = F.lit(dt.date(2024, 1, 24)).cast("timestamp_ntz")
    ev = S.events(spark, d)
    dr = D.windowed_drift(ev, "ts", "day", "value").where(F.col("window_start") >= since)
    vol = ev.where(F.col("ts") >= since).groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.count("*").cast("double").alias("value"))

    def part(df, name, value):
        return df.select(F.lit(name).alias("part"), F.date_format("window_start", "yyyy-MM-dd").alias("at"), value.alias("value"))

    return part(vol, "metric", F.col("value")).unionByName(part(dr, "drift", F.round("js_divergence", 6))).unionByName(
        part(D.drift_alerts(dr, 0.05), "alert", F.round("drift_score", 6))
    )


# -- privacy ---------------------------------------------------------------

def _text_sql(table, keys, text="text"):
    counts = ", ".join(f"len(regexp_extract_all({text}, '{rx}')) AS {n}_count" for n, rx in P.TEXT_PATTERNS.items())
    hits = " OR ".join(f"{n}_count > 0" for n in P.TEXT_PATTERNS)
    return f"SELECT * FROM (SELECT {keys}, {counts} FROM {table}) WHERE {hits}"


@query("pr01_text_identifiers", _text_sql("documents", "doc_id"))
def pr01(spark, d):
    return P.scan_text(S.table(spark, d, "documents"), "text", ["doc_id"])


@query("pr01_conversation_identifiers", _text_sql("conversations", "conv_id, turn"))
def pr01_conversations(spark, d):
    return P.scan_text(S.table(spark, d, "conversations"), "text", ["conv_id", "turn"])


@query("pr01_page_identifiers", _text_sql("pages", "page_id", "html"))
def pr01_pages(spark, d):
    return P.scan_text(S.table(spark, d, "pages"), "html", ["page_id"])


_MASK = {
    "member_id": "sha256(member_id)", "ssn": "'XXX-XX-' || right(replace(ssn, '-', ''), 4)", "phone": "'XXX-XXX-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4)",
    "email": "CASE WHEN contains(email, '@') THEN substr(email, 1, 1) || '***@' || split_part(email, '@', 2) END",
}


@query("pr02_masked_members", f"SELECT custkey, {', '.join(f'{v} AS {k}' for k, v in _MASK.items())} FROM members")
def pr02(spark, d):
    return P.masked(S.members(spark, d)).select("custkey", *_MASK)


@query("pr03_deidentified", "SELECT CASE WHEN state = 'CA' THEN member_id ELSE sha256(member_id) END AS member_id, custkey, plan_type FROM members")
def pr03(spark, d):
    return P.deidentified(S.members(spark, d), F.col("state") == "CA").select("member_id", "custkey", "plan_type")


@query("pr04_masked_rule", """
SELECT 'email' AS column_name, count(*) FILTER (WHERE email IS NULL OR contains(email, '***')) AS masked, count(*) AS total, count(*) FILTER (WHERE email IS NULL) AS raw_masked FROM (
 SELECT CASE WHEN contains(email, '@') THEN substr(email, 1, 1) || '***@' || split_part(email, '@', 2) END AS email FROM members)""")
def pr04(spark, d):
    masked = P.masked(S.members(spark, d))
    return masked.agg(
        F.count_if(P.is_masked("email")).alias("masked"), F.count("*").alias("total"), F.count_if(F.col("email").isNull()).alias("raw_masked")
    ).select(F.lit("email").alias("column_name"), "masked", "total", "raw_masked")


_TOUCH = " OR ".join(f"contains(accessed_columns, '{w}')" for w in P.PHI_WORDS)


@query("pr05_access_audit", f"""
SELECT 'phi' AS audit, count(*) AS n, count(DISTINCT user_id) AS users FROM audit_logs WHERE ({_TOUCH}) AND access_time >= TIMESTAMP '2024-01-11'
UNION ALL SELECT 'export', count(*), count(DISTINCT user_id) FROM audit_logs WHERE action_name IN ('EXPORT', 'DOWNLOAD', 'COPY') AND access_time >= TIMESTAMP '2024-01-21'
UNION ALL SELECT 'admin', count(*), count(DISTINCT user_id) FROM audit_logs WHERE action_name IN ('CREATE', 'DROP', 'ALTER', 'GRANT', 'REVOKE') AND access_time >= TIMESTAMP '2024-01-11'""")
def pr05(spark, d):
    logs, at = S.audit_logs(spark, d), S.EVENTS_AS_OF

    def tally(df, name):
        return df.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.lit(name).alias("audit"), "n", "users")

    return tally(P.phi_access(logs, at, 20), "phi").unionByName(tally(P.exports(logs, at, 10), "export")).unionByName(
        tally(P.admin_actions(logs, at, 20), "admin")
    )


@query("pr05_suspicious_access", """
SELECT user_id, count(*) FILTER (WHERE rows_affected > 10000) AS bulk_reads, count(*) FILTER (WHERE hour(access_time) >= 22 OR hour(access_time) < 6) AS night_accesses, count(*) FILTER (WHERE action_name = 'LOGIN_FAILED') AS failed_logins,
  count(*) FILTER (WHERE action_name = 'LOGIN_FAILED') >= 5 AS locked_candidate FROM audit_logs GROUP BY 1""")
def pr05_suspicious(spark, d):
    return P.suspicious_access(S.audit_logs(spark, d))


# -- compliance and reports ------------------------------------------------

@query("qa21_compliance", """
SELECT check_name, round(s, 6) AS score, s >= 95 AS compliant FROM (SELECT 100.0::double * count(*) FILTER (WHERE created_date IS NOT NULL AND claim_status IS NOT NULL) / count(*) AS a,
  100.0::double * count(*) FILTER (WHERE regexp_matches(diagnosis_code, '^[A-TV-Z][0-9][A-Z0-9]$') AND regexp_matches(procedure_code, '^[0-9]{5}$')) / count(*) AS b,
  100.0::double * count(*) FILTER (WHERE EXISTS (SELECT 1 FROM eligibility e WHERE e.member_id = c.member_id AND c.date_of_service BETWEEN e.start_date AND coalesce(e.end_date, DATE '2099-12-31'))) / count(*) AS e,
  100.0::double * count(*) FILTER (WHERE provider_npi IN (SELECT provider_npi FROM providers WHERE status = 'ACTIVE')) / count(*) AS f,
  100.0::double * count(*) FILTER (WHERE claim_amount BETWEEN 0 AND 1000000) / count(*) AS g FROM claims c),
LATERAL (VALUES ('audit_trail', a), ('coding_accuracy', b), ('member_eligibility', e), ('provider_status', f), ('claim_amounts', g), ('overall', (a + b + e + f + g) / 5)) v(check_name, s)""")
def qa21(spark, d):
    rows = R.claims_with_flags(S.claims(spark, d), S.eligibility(spark, d), S.providers(spark, d))
    return R.compliance(rows, {k: F.col(k) for k in R.claim_checks()}).withColumn("score", F.round("score", 6))


@query("rp01_executive_summary", """
SELECT 'claims' AS table_name, round(o, 6) AS overall_score, 95.0::double AS target, CASE WHEN o >= 90 THEN 'good' WHEN o >= 80 THEN 'warning' ELSE 'critical' END AS status, round(c, 6) AS completeness,
 round(v, 6) AS validity, n AS critical_issues, (SELECT count(*) FROM claims_feed) AS total_records FROM (SELECT (SELECT overall_score FROM overall) AS o, (SELECT score FROM dim_scores WHERE dimension = 'completeness') AS c,
 (SELECT score FROM dim_scores WHERE dimension = 'validity') AS v, (SELECT count(*) FROM issues WHERE severity = 'critical') AS n)""")
def rp01(spark, d):
    from dqflow.catalog.quality import assessed, rules
    from dqflow.operators import assess as A

    out = R.executive_summary(A.summary_row(assessed(spark, d), "claims", rules()))
    return out.withColumns({c: F.round(c, 6) for c in ("overall_score", "completeness", "validity")})


@query("rp02_detailed_report", """
SELECT 'dimension' AS section, dimension AS name, round(score, 6) AS value FROM dim_scores UNION ALL SELECT 'field', field, round(avg(score), 6) FROM field_dims GROUP BY 2
UNION ALL SELECT 'rule', field || '.' || rule, round(score, 6) FROM rule_results WHERE NOT passed UNION ALL SELECT 'issue', type, round(measured, 6) FROM issues""")
def rp02(spark, d):
    from dqflow.catalog.quality import settled

    return R.detailed_report(settled(spark, d)).withColumn("value", F.round("value", 6))


@query("rp02_full_report", """
SELECT 'dimension' AS section, dimension AS name, round(score, 6) AS value FROM dim_scores UNION ALL SELECT 'field', field, round(avg(score), 6) FROM field_dims GROUP BY 2
UNION ALL SELECT 'rule', field || '.' || rule, round(score, 6) FROM rule_results WHERE NOT passed UNION ALL SELECT 'issue', type, round(measured, 6) FROM issues
UNION ALL SELECT 'anomaly', anomaly_type || '.' || severity, sum(affected_records)::double FROM findings GROUP BY 2
UNION ALL SELECT 'recommendation', recommendation, position::double FROM advised""")
def rp02_full(spark, d):
    """The report with findings of all detectors and the recommendations that the scores call for."""
    from dqflow.catalog.anomalies import findings
    from dqflow.catalog.quality import settled

    return R.detailed_report(settled(spark, d), findings(spark, d), advice=True).withColumn("value", F.round("value", 6))


@query("rp01_trend", """
SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, records, round(s, 6) AS avg_score, round(prev, 6) AS previous_score,
  CASE WHEN prev IS NULL OR round(s - prev, 6) = 0 THEN 'stable' WHEN s > prev THEN 'up' ELSE 'down' END AS trend, periods, round(95 - s, 6) AS gap_to_target
FROM (SELECT *, lag(s) OVER (ORDER BY period) AS prev, count(*) OVER () AS periods, row_number() OVER (ORDER BY period DESC) AS r FROM (
  SELECT date_trunc('month', created_date) AS period, count(*) AS records, sum(((CASE WHEN member_id IS NULL THEN 0 ELSE 1 END
    + CASE WHEN date_of_service IS NULL THEN 0 ELSE 1 END + CASE WHEN admission_date IS NULL THEN 0 ELSE 1 END + 1) * 25)::decimal(12,4))::double / count(*) AS s
  FROM claims_feed GROUP BY 1)) WHERE r = 1""")
def rp01_trend(spark, d):
    """Completeness of the newest month of claims beside the month before."""
    out = R.quality_trend(S.claims_feed(spark, d), "created_date", ["claim_id", "member_id", "date_of_service", "admission_date"])
    return out.withColumns({c: F.round(c, 6) for c in ("avg_score", "previous_score")})


add_view("monitor_days", """
SELECT date_trunc('day', ts)::timestamp AS t, count(*) AS n, count(*) - count(value) AS nulls, min(value) AS low, max(value) AS high
FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
add_view("monitor_moves", "SELECT w::timestamp AS t, js FROM daily_drift WHERE w >= DATE '2024-01-24'")


@query("mo07_bundle", """
SELECT part, strftime(t, '%Y-%m-%d %H:%M') AS at, name, round(value, 6) AS value FROM (
SELECT 'metric' AS part, t, 'records' AS name, n::double AS value FROM monitor_days UNION ALL SELECT 'profile', t, 'nulls', nulls::double FROM monitor_days
UNION ALL SELECT 'profile', t, 'low', low::double FROM monitor_days UNION ALL SELECT 'profile', t, 'high', high::double FROM monitor_days
UNION ALL SELECT 'drift', t, 'value', js FROM monitor_moves UNION ALL SELECT 'alert', t, 'value', sqrt(js) FROM monitor_moves WHERE sqrt(js) > .05
UNION ALL SELECT 'summary', NULL, 'windows', count(*)::double FROM monitor_days UNION ALL SELECT 'summary', NULL, 'records', sum(n)::double FROM monitor_days
UNION ALL SELECT 'summary', NULL, 'largest drift', max(js) FROM monitor_moves UNION ALL SELECT 'summary', NULL, 'alerts', count(*)::double FROM monitor_moves WHERE sqrt(js) > .05)""")
def mo07_bundle(spark, d):
    """The monitor page of the last week: volume, profile, drift, alerts and their summary."""
    since = F.lit(dt.date(2024, 1, 24)).cast("timestamp_ntz")
    return R.monitor_bundle(S.events(spark, d), "ts", "value", since).withColumn("value", F.round("value", 6))
