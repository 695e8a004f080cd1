"""Registered queries: alerts, runs, usage, billing (AL, RH, US, BI, TK04, TK05)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import add_view, query
from dqflow.operators import alerts as AL
from dqflow.operators import marts as M
from dqflow.operators import runs as R
from dqflow.operators import usage as U

SINCE = dt.datetime(2024, 1, 30)
END = dt.date(2024, 2, 1)


def stamp(c, name=None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or c)


def sql_stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


# -- alerts ----------------------------------------------------------------

@query("al01_table_alerts", """
SELECT alert_type, severity, measured, threshold FROM table_metrics, LATERAL (VALUES ('low_quality_score', 'high', avg_quality_score, .99::double, avg_quality_score < .99),
 ('high_anomaly_rate', 'medium', high_anomaly_percentage, 5.0, high_anomaly_percentage > 5), ('stale_data', 'medium', stale_percentage, 10.0, stale_percentage > 10)) v(alert_type, severity, measured, threshold, hit) WHERE hit""")
def al01(spark, d):
    from dqflow.catalog.quality import scored

    return AL.table_alerts(M.table_metrics(scored(spark, d)), {"min_quality_score": 0.99})


@query("al02_assessment_alert", """
SELECT CASE WHEN o < 60 OR c > 0 THEN 'critical' WHEN o < 80 THEN 'warning' ELSE 'none' END AS level, c AS critical_issues
FROM (SELECT (SELECT overall_score FROM overall) AS o, (SELECT count(*) FROM issues WHERE severity = 'critical') AS c)""")
def al02(spark, d):
    from dqflow.catalog.quality import assessed, rules
    from dqflow.operators import assess as A

    row = A.summary_row(assessed(spark, d), "claims", rules())
    return row.select(AL.assessment_alert(F.col("overall_score"), F.col("critical_issues")).alias("level"), "critical_issues")


@query("al03_condition_alerts", """
SELECT severity, condition FROM (SELECT count(member_id)::double / count(*) AS c, count(*) FILTER (WHERE regexp_matches(diagnosis_code, '^[A-TV-Z][0-9][A-Z0-9]$'))::double / count(*) AS v, sum(q10) / 10.0 / count(*) AS q, max(fresh) AS h, count(*) FILTER (WHERE a10 > 7) AS a, count(*) FILTER (WHERE claim_amount < 0) AS x FROM scored),
LATERAL (VALUES ('critical', 'overall_quality_score < 0.60', q < .6), ('critical', 'completeness_score < 0.70', c < .7), ('critical', 'validity_score < 0.75', v < .75), ('critical', 'critical_violations > 0', x > 0),
 ('warning', 'overall_quality_score < 0.80', q < .8), ('warning', 'completeness_score < 0.85', c < .85), ('warning', 'data_age_hours > 24', h > 24), ('warning', 'anomaly_count > 100', a > 100), ('info', 'previous_quality_score > overall_quality_score', 1.0 > q)) t(severity, condition, hit) WHERE hit""")
def al03(spark, d):
    from dqflow.catalog.quality import scored
    from dqflow.functions.codes import is_diagnosis_loose

    n = F.count(F.lit(1))
    row = scored(spark, d).agg(
        (F.sum(F.col("_quality_score").cast("decimal(4,1)")).cast("double") / n).alias("overall_quality_score"),
        (F.count("member_id") / n).alias("completeness_score"),
        (F.count_if(is_diagnosis_loose("diagnosis_code")) / n).alias("validity_score"),
        F.count_if(F.col("claim_amount") < 0).alias("critical_violations"),
        F.max("_data_freshness_hours").alias("data_age_hours"),
        F.count_if(F.col("_anomaly_score") > 0.7).alias("anomaly_count"),
        F.lit(1.0).alias("previous_quality_score"),
    )
    return AL.condition_alerts(row)


_RULES = ", ".join(f"('{n}', '{m}', '{o}', {t}, '{s}')" for n, m, o, t, s in (*AL.METRIC_RULES, *AL.OPERATIONS_RULES))
add_view("rule_alerts", f"""SELECT m.event_id, m.timestamp, m.tenant_id, m.component, m.value, r.* FROM metrics m JOIN (VALUES {_RULES}) r(rule, metric, operator, lim, severity) ON r.metric = m.metric_name
WHERE CASE operator WHEN '>' THEN value > lim WHEN '<' THEN value < lim ELSE value = lim END""")
ALL_RULES = (*AL.METRIC_RULES, *AL.OPERATIONS_RULES)


@query("al05_metric_rules", "SELECT event_id, rule, severity, value::double AS value, lim::double AS lim FROM rule_alerts")
def al05(spark, d):
    return AL.check_rules(S.metrics(spark, d), ALL_RULES).select("event_id", "rule", "severity", F.col("value").cast("double").alias("value"), F.col("limit").alias("lim"))


@query("al04_suppression", """
SELECT event_id, rule, coalesce(timestamp - prev <= INTERVAL 60 MINUTE, false) AS suppressed, hour(timestamp) >= 22 OR hour(timestamp) < 6 AS quiet_hours
FROM (SELECT *, lag(timestamp) OVER (PARTITION BY rule, tenant_id ORDER BY timestamp, event_id) AS prev FROM rule_alerts)""")
def al04(spark, d):
    raised = AL.check_rules(S.metrics(spark, d), ALL_RULES)
    return AL.suppress(raised, ["rule", "tenant_id"], "timestamp", ["timestamp", "event_id"]).select("event_id", "rule", "suppressed", "quiet_hours")


@query("al11_operations_rules", """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM (SELECT access_time AS timestamp FROM audit_logs WHERE action_name = 'LOGIN_FAILED') GROUP BY 1 HAVING count(*) > 2""")
def al11(spark, d):
    failed = S.audit_logs(spark, d).where("action_name = 'LOGIN_FAILED'")
    out = AL.burst_alerts(failed, "access_time", limit=2)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


add_view("alert_state", """
WITH t AS (SELECT alert_id, min((timestamp, event_id)) AS t0 FROM alert_events WHERE action = 'trigger' GROUP BY 1),
r AS (SELECT e.alert_id, min((timestamp, event_id)) AS res FROM alert_events e JOIN t USING (alert_id) WHERE action = 'resolve' AND (timestamp, event_id) > t0 GROUP BY 1),
a AS (SELECT e.alert_id, min((timestamp, event_id)) AS ack FROM alert_events e JOIN t USING (alert_id) LEFT JOIN r USING (alert_id) WHERE action = 'acknowledge' AND (timestamp, event_id) > t0 AND (res IS NULL OR (timestamp, event_id) < res) GROUP BY 1)
SELECT DISTINCT e.alert_id, tenant_id, severity, component, CASE WHEN res IS NOT NULL THEN 'resolved' WHEN ack IS NOT NULL THEN 'acknowledged' ELSE 'triggered' END AS status, t0[1] AS triggered_at, ack[1] AS acknowledged_at, res[1] AS resolved_at
FROM alert_events e JOIN t USING (alert_id) LEFT JOIN r USING (alert_id) LEFT JOIN a USING (alert_id)""")


@query("al06_lifecycle", f"""SELECT alert_id, tenant_id, severity, component, status, {sql_stamp('triggered_at')} AS triggered_at, {sql_stamp('acknowledged_at')} AS acknowledged_at, {sql_stamp('resolved_at')} AS resolved_at FROM alert_state""")
def al06(spark, d):
    out = AL.lifecycle(S.alert_events(spark, d))
    return out.select("alert_id", "tenant_id", "severity", "component", "status", stamp("triggered_at"), stamp("acknowledged_at"), stamp("resolved_at"))


@query("al07_active_alerts", f"SELECT alert_id, severity, status, {sql_stamp('triggered_at')} AS triggered_at FROM alert_state WHERE status <> 'resolved'")
def al07(spark, d):
    return AL.active(AL.lifecycle(S.alert_events(spark, d))).select("alert_id", "severity", "status", stamp("triggered_at"))


add_view("health", """
SELECT *, lag(status) OVER w AS previous_status, CASE WHEN status = 'healthy' THEN 0 ELSE rn - coalesce(max(CASE WHEN status = 'healthy' THEN rn END) OVER (PARTITION BY component ORDER BY rn), 0) END AS failures
FROM (SELECT *, CASE WHEN response_time > 5000 THEN 'unhealthy' WHEN response_time > 1000 THEN 'degraded' WHEN error THEN 'unhealthy' ELSE 'healthy' END AS status,
  row_number() OVER (PARTITION BY component ORDER BY timestamp, event_id) AS rn FROM health_checks) WINDOW w AS (PARTITION BY component ORDER BY rn)""")


@query("al08_component_health", "SELECT event_id, component, status, previous_status, failures::bigint AS consecutive_failures FROM health")
def al08(spark, d):
    return AL.health_history(S.health_checks(spark, d)).select(
        "event_id", "component", "status", "previous_status", F.col("consecutive_failures").cast("bigint").alias("consecutive_failures")
    )


@query("al08_health_alerts", """
SELECT event_id, component, CASE status WHEN 'unhealthy' THEN 'error' WHEN 'degraded' THEN 'warning' ELSE 'resolve' END AS alert FROM health
WHERE coalesce(previous_status, 'unknown') <> status AND (status <> 'healthy' OR previous_status IS NOT NULL)""")
def al08_alerts(spark, d):
    return AL.health_alerts(AL.health_history(S.health_checks(spark, d))).select("event_id", "component", "alert")


@query("al06_auto_resolution", f"""
SELECT a.alert_id, {sql_stamp('a.triggered_at')} AS triggered_at, {sql_stamp('min(h.timestamp)')} AS resolved_at
FROM alert_state a LEFT JOIN (SELECT * FROM health WHERE status = 'healthy' AND previous_status <> 'healthy') h ON h.component = a.component AND h.timestamp > a.triggered_at GROUP BY 1, a.triggered_at""")
def al06_auto(spark, d):
    recoveries = AL.health_alerts(AL.health_history(S.health_checks(spark, d))).where("alert = 'resolve'")
    out = AL.next_recovery(AL.lifecycle(S.alert_events(spark, d)), recoveries)
    return out.select("alert_id", stamp("triggered_at"), stamp("resolved_at"))


@query("al09_overall_status", """
SELECT healthy, degraded, unhealthy, critical, error, warning, info, CASE WHEN critical > 0 THEN 'unhealthy' WHEN error > 0 OR unhealthy > 0 OR warning > 0 OR degraded > 0 THEN 'degraded' ELSE 'healthy' END AS overall_status FROM
(SELECT count(*) FILTER (WHERE status = 'healthy') AS healthy, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) FILTER (WHERE status = 'unhealthy') AS unhealthy FROM (SELECT component, arg_max(status, (timestamp, event_id)) AS status FROM health GROUP BY 1)),
(SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM alert_state WHERE status <> 'resolved')""")
def al09(spark, d):
    checks = S.health_checks(spark, d).withColumn("status", AL.health_status(1000.0, 5000.0))
    latest = checks.groupBy("component").agg(F.max_by("status", F.struct("timestamp", "event_id")).alias("status"))
    return AL.overall_status(latest, AL.active(AL.lifecycle(S.alert_events(spark, d))))


@query("al10_metrics_summary", """
SELECT metric_name, count(*) AS n, min(value)::double AS min_value, max(value)::double AS max_value, sum(value)::double / count(*) AS avg_value, arg_max(value, (timestamp, event_id))::double AS latest
FROM metrics WHERE timestamp >= TIMESTAMP '2024-01-30' GROUP BY 1""")
def al10(spark, d):
    out = AL.metrics_summary(S.metrics(spark, d), SINCE)
    return out.withColumns({c: F.col(c).cast("double") for c in ("min_value", "max_value", "latest")})


# -- runs ------------------------------------------------------------------

def failed(spark, d):
    return S.runs(spark, d).where("status = 'FAILED'")


@query("rh01_job_health", """
SELECT pipeline_id, count(*) AS total_runs, count(*) FILTER (WHERE status = 'SUCCESS') AS successful_runs, count(*) FILTER (WHERE status = 'FAILED') AS failed_runs,
  round(count(*) FILTER (WHERE status = 'SUCCESS') * 100.0::double / count(*), 6) AS success_rate, sum(execution_time_seconds)::double / count(*) / 60 AS average_duration_minutes,
  count(*) FILTER (WHERE status = 'FAILED') AS recent_failures, arg_max(status, (started_at, event_id)) AS last_run_status FROM runs GROUP BY 1""")
def rh01(spark, d):
    return R.job_health(S.runs(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@query("rh01_newest_failures", """
SELECT pipeline_id, total_runs, failed_runs, newest_failures FROM (
  SELECT pipeline_id, count(*) AS total_runs, count(*) FILTER (WHERE status = 'FAILED') AS failed_runs FROM runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1)
LEFT JOIN (SELECT pipeline_id, string_agg(run_id, ',' ORDER BY r) AS newest_failures FROM (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, event_id DESC) AS r FROM runs WHERE status = 'FAILED' AND started_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) WHERE r <= 5 GROUP BY 1) USING (pipeline_id)""")
def rh01_newest(spark, d):
    """Health over the last seven days with the newest five failures beside their true number."""
    week = R.since(S.runs(spark, d), S.EVENTS_AS_OF, 7)
    return R.job_health(week).join(R.newest_failures(week), "pipeline_id", "left").select(
        "pipeline_id", "total_runs", "failed_runs", F.array_join("newest_failures", ",").alias("newest_failures"))


@query("rh02_failure_type", """
SELECT error_message, CASE WHEN regexp_matches(m, 'memory|heap space') THEN 'resource_constraint' WHEN regexp_matches(m, 'timeout|deadline exceeded') THEN 'timeout' WHEN regexp_matches(m, 'schema|column') THEN 'schema_drift'
  WHEN regexp_matches(m, 'quality|expectation') THEN 'data_quality' ELSE 'unknown' END AS type, NOT regexp_matches(m, 'schema|column|quality|expectation') AS can_retry, count(*) AS n
FROM (SELECT *, lower(error_message) AS m FROM runs WHERE status = 'FAILED') GROUP BY 1, 2, 3""")
def rh02(spark, d):
    t = R.failure_type(F.col("error_message"))
    return failed(spark, d).groupBy("error_message", t["type"].alias("type"), t["can_retry"].alias("can_retry")).agg(F.count("*").alias("n"))


def _cat(m):
    return "CASE " + " ".join(f"WHEN regexp_matches({m}, '{'|'.join(w)}') THEN '{n}'" for n, w in R.CATEGORY_WORDS) + " ELSE 'unknown' END"


add_view("failures", f"SELECT *, {_cat('lower(error_message)')} AS category FROM runs WHERE status = 'FAILED'")


@query("rh03_failure_category", """
SELECT error_message, category, regexp_matches(lower(error_message), 'file not found|table does not exist|invalid credentials|access denied|syntax error|illegal argument') AS permanent, count(*) AS n FROM failures GROUP BY 1, 2, 3""")
def rh03(spark, d):
    m = F.col("error_message")
    return failed(spark, d).groupBy("error_message", R.failure_category(m).alias("category"), R.is_permanent(m).alias("permanent")).agg(F.count("*").alias("n"))


_POLICY = ", ".join(f"('{c}', {p[0]}, {p[1]}, {p[2]}, '{p[3]}', {p[4]}::double)" for c, p in R.RETRY_POLICY.items())


@query("rh04_retry_plan", f"""
SELECT event_id, category, f1 AS failures_1h, f2 AS failures_2h,
  retry_count < max_retries AND NOT regexp_matches(lower(error_message), 'access denied') AND (f1 < 3 OR CASE WHEN category IN ('schema_drift', 'configuration') THEN false WHEN category = 'resource_constraint' THEN retry_count < 2 ELSE true END) AS should_retry,
  floor(greatest(1, least(max_delay, CASE strategy WHEN 'exponential' THEN base * mult ** retry_count WHEN 'linear' THEN base * (1 + retry_count) WHEN 'fixed' THEN base
    ELSE floor(base * CASE WHEN f2 > 5 THEN 1.5::double + (f2 - 5) * 0.2::double ELSE mult ** retry_count END) END)))::bigint AS delay_seconds
FROM (SELECT *, count(*) OVER (PARTITION BY category ORDER BY started_at RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS f1,
  count(*) OVER (PARTITION BY category ORDER BY started_at RANGE BETWEEN INTERVAL '7199.999999 seconds' PRECEDING AND CURRENT ROW) AS f2 FROM failures)
JOIN (VALUES {_POLICY}) p(category, max_retries, base, max_delay, strategy, mult) USING (category)""")
def rh04(spark, d):
    return R.retry_plan(failed(spark, d)).select("event_id", "category", "failures_1h", "failures_2h", "should_retry", "delay_seconds")


@query("rh05_recent_retries", """
SELECT pipeline_id, n AS retries, CASE WHEN n < 3 THEN least(300.0::double, 60.0::double * 2.0::double ** n) END AS backoff_seconds FROM (
SELECT pipeline_id, count(*) FILTER (WHERE started_at >= TIMESTAMP '2024-01-30 20:00:00' AND retry_count > 0) AS n FROM runs GROUP BY 1)""")
def rh05(spark, d):
    return R.recent_retries(S.runs(spark, d), dt.datetime(2024, 1, 31), hours=4)


@query("rh06_failure_statistics", """
SELECT sum(n)::bigint AS total_failures, round(sum(r)::double / sum(n)::double * 100, 1) AS resolution_rate, arg_max(category, (n, category)) AS most_common_category, round(sum(t)::double / sum(n)::double, 1) AS avg_retries_per_failure, count(*) AS categories
FROM (SELECT category, count(*) AS n, count(*) FILTER (WHERE resolved) AS r, sum(retry_count) AS t FROM failures WHERE started_at >= TIMESTAMP '2024-01-30' GROUP BY 1)""")
def rh06(spark, d):
    recent = failed(spark, d).where(F.col("started_at") >= F.lit(SINCE).cast("timestamp_ntz"))
    return R.failure_statistics(recent).withColumn("categories", F.size("categories").cast("bigint"))


@query("rh06_retry_advice", """
SELECT type FROM (SELECT round(count(*) FILTER (WHERE resolved)::double / count(*) * 100, 1) AS rr, round(sum(retry_count)::double / count(*), 1) AS ar FROM failures),
LATERAL (VALUES ('resolution_rate', rr < 70), ('retry_optimization', ar > 2), ('resource_scaling', (SELECT arg_max(category, (n, category)) FROM (SELECT category, count(*) AS n FROM failures GROUP BY 1)) = 'resource_constraint')) v(type, hit) WHERE hit""")
def rh06_advice(spark, d):
    return R.retry_advice(R.failure_statistics(failed(spark, d))).select("type")


@query("rh07_health_score", """
SELECT pipeline_id, s AS health_score, CASE WHEN s >= 85 THEN 'healthy' WHEN s >= 70 THEN 'warning' ELSE 'critical' END AS health FROM (
SELECT pipeline_id, 100 - CASE WHEN bad THEN 50 ELSE 0 END - CASE last WHEN 'FAILED' THEN 30 WHEN 'CANCELLED' THEN 20 ELSE 0 END AS s FROM (
SELECT pipeline_id, arg_max(status, (started_at, event_id)) AS last, count(*) FILTER (WHERE status = 'FAILED') * 5 > count(*) AS bad FROM runs GROUP BY 1))""")
def rh07(spark, d):
    g = S.runs(spark, d).groupBy("pipeline_id").agg(
        F.max_by("status", F.struct("started_at", "event_id")).alias("last"),
        (F.count_if(F.col("status") == "FAILED") * 5 > F.count("*")).alias("bad"),
    )
    score = R.run_health_score(F.when(F.col("bad"), F.lit("FAILED")).otherwise(F.lit("RUNNING")), F.col("last"))
    return g.select("pipeline_id", score.alias("health_score"), R.health_label(score).alias("health"))


@query("rh08_run_statistics", """
SELECT tenant_id, pipeline_id, count(*) AS runs, round(count(*) FILTER (WHERE status = 'SUCCESS') * 100.0::double / count(*), 6) AS success_rate, sum(execution_time_seconds)::double / count(*) AS mean_runtime_seconds, sum(gb_processed)::double AS gb_processed FROM runs GROUP BY 1, 2""")
def rh08(spark, d):
    return R.run_statistics(S.runs(spark, d)).withColumns({"success_rate": F.round("success_rate", 6), "gb_processed": F.col("gb_processed").cast("double")})


_TENANT = """SELECT tenant_id, count(DISTINCT pipeline_id) AS active_pipelines, count(*) AS runs, sum(gb_processed) AS gb_processed, count(*) FILTER (WHERE status = 'SUCCESS') AS ok FROM runs GROUP BY 1"""


@query("rh09_tenant_rollup", f"""
SELECT tenant_id, active_pipelines, runs, gb_processed::double AS gb_processed, round(ok * 100.0::double / runs, 6) AS success_rate, round(gb_processed::double / 1000 * 100, 6) AS utilisation_percentage FROM ({_TENANT})
UNION ALL SELECT 'platform', sum(active_pipelines)::bigint, sum(runs)::bigint, sum(gb_processed)::double, NULL, NULL FROM ({_TENANT})""")
def rh09(spark, d):
    t = R.tenant_rollup(S.runs(spark, d), F.lit(1000.0))
    p = R.platform_rollup(t).select(F.lit("platform").alias("tenant_id"), "active_pipelines", "runs", "gb_processed")
    out = t.unionByName(p, allowMissingColumns=True)
    return out.select(
        "tenant_id", "active_pipelines", "runs", F.col("gb_processed").cast("double").alias("gb_processed"),
        F.round("success_rate", 6).alias("success_rate"), F.round("utilisation_percentage", 6).alias("utilisation_percentage"),
    )


# -- usage -----------------------------------------------------------------

_WIDE = ", ".join(f"sum(quantity) FILTER (WHERE event_type = '{m}')::double AS {m}" for m in U.METRICS)
_COST = " + ".join(f"coalesce(sum(quantity) FILTER (WHERE event_type = '{m}'), 0) * {p}" for m, p in U.PRICES.items())


@query("us01_tenant_usage", f"""
SELECT tenant_id, pipeline_id, strftime(timestamp, '%Y-%m-%d') AS day, {_WIDE}, count(*) AS event_count, ({_COST})::double AS estimated_cost FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-05' GROUP BY 1, 2, 3""")
def us01(spark, d):
    ev = S.usage_events(spark, d).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    out = U.tenant_usage(ev, "tenant_id", "pipeline_id", "day", start=dt.datetime(2024, 1, 5))
    return out.withColumns({c: F.col(c).cast("double") for c in (*U.METRICS, "estimated_cost")})


@query("us02_hourly_usage", """
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour, tenant_id, event_type, sum(quantity)::double AS quantity FROM usage_events GROUP BY 1, 2, 3""")
def us02(spark, d):
    return U.hourly_usage(S.usage_events(spark, d)).select(
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "tenant_id", "event_type", F.col("quantity").cast("double").alias("quantity")
    )


@query("us03_platform_analytics", """
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS hour, count(DISTINCT tenant_id) AS active_tenants, sum(quantity)::double AS total_usage FROM usage_events GROUP BY 1
UNION ALL SELECT 'total ' || event_type, count(DISTINCT tenant_id), sum(quantity)::double FROM usage_events GROUP BY 1
UNION ALL SELECT 'recent ' || event_type, count(DISTINCT tenant_id), sum(quantity)::double FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-30' GROUP BY 1
UNION ALL SELECT 'day ' || strftime(timestamp, '%Y-%m-%d'), count(DISTINCT tenant_id), sum(quantity)::double FROM usage_events WHERE timestamp >= TIMESTAMP '2024-01-24' GROUP BY 1""")
def us03(spark, d):
    """Hourly activity, totals, the last day and a week's trend from one tenant-hour rollup."""
    h = U.hourly_usage(S.usage_events(spark, d))
    aggs = [F.countDistinct("tenant_id").alias("active_tenants"), F.sum("quantity").cast("double").alias("total_usage")]
    at = F.lit("2024-01-30").cast("timestamp_ntz")
    week = F.lit("2024-01-24").cast("timestamp_ntz")

    def part(df, label):
        return df.groupBy(label.alias("hour")).agg(*aggs)

    return (
        part(h, F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))
        .unionByName(part(h, F.concat(F.lit("total "), "event_type")))
        .unionByName(part(h.where(F.col("hour") >= at), F.concat(F.lit("recent "), "event_type")))
        .unionByName(part(h.where(F.col("hour") >= week), F.concat(F.lit("day "), F.date_format("hour", "yyyy-MM-dd"))))
    )


@query("tk04_top_tenants", "SELECT tenant_id, sum(quantity)::double AS total_usage FROM usage_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tk04(spark, d):
    return U.top_tenants(S.usage_events(spark, d)).withColumn("total_usage", F.col("total_usage").cast("double"))


_PLANS = ", ".join(
    f"('{p}', {v[0]}::decimal(12,2), '{m}', {inc}, {r}::decimal(10,4))" for p, v in U.PLANS.items() for m, inc, r in zip(U.METRICS, v[1], v[2])
)
add_view("plans", f"SELECT * FROM (VALUES {_PLANS}) p(plan_id, fee, event_type, included, rate)")
add_view("billed", """
SELECT u.tenant_id, u.event_type, q, plan_id, billing_period, current_period_end, fee, included, rate, greatest(q - included, 0) AS overage, round(greatest(q - included, 0) * rate, 2)::decimal(18,2) AS line_cost
FROM (SELECT tenant_id, event_type, sum(quantity) AS q FROM usage_events GROUP BY 1, 2) u JOIN accounts USING (tenant_id) JOIN plans p USING (plan_id, event_type)""")


@query("us04_usage_alerts", """
SELECT tenant_id, event_type, round(q::double / included * 100, 6) AS usage_percentage, CASE WHEN q::double / included * 100 > 95 THEN 'high' ELSE 'medium' END AS severity FROM billed WHERE q::double / included * 100 > 80""")
def us04(spark, d):
    use = U.usage_by(S.usage_events(spark, d), "tenant_id")
    return U.usage_alerts(use, S.accounts(spark, d)).select("tenant_id", "event_type", F.round("usage_percentage", 6).alias("usage_percentage"), "severity")


@query("us05_events_from_runs", """
SELECT tenant_id, 'gb_processed' AS event_type, sum(gb_processed)::double AS quantity, count(*) AS events FROM runs GROUP BY 1
UNION ALL SELECT tenant_id, 'quality_checks', count(*)::double, count(*) FROM runs GROUP BY 1""")
def us05(spark, d):
    made = U.events_from_runs(S.runs(spark, d)).where("event_type != 'compute_hours'")
    return made.groupBy("tenant_id", "event_type").agg(F.sum("quantity").cast("double").alias("quantity"), F.count("*").alias("events"))


@query("us05_compute_hours", """
SELECT tenant_id, round(sum(execution_time_seconds)::double / 3600, 2) AS compute_hours FROM runs GROUP BY 1""")
def us05_hours(spark, d):
    made = U.events_from_runs(S.runs(spark, d)).where("event_type = 'compute_hours'")
    return made.groupBy("tenant_id").agg(F.round(F.sum("quantity").cast("double"), 2).alias("compute_hours"))


_PRICE = "CASE event_type " + " ".join(f"WHEN '{m}' THEN {p}::decimal(10,4)" for m, p in U.PRICES.items()) + " END"


@query("us06_cost_rollup", f"""
SELECT event_type, pipeline_id, sum(quantity * {_PRICE})::double AS cost, count(*) AS records, sum(quantity * {_PRICE})::double / count(*) AS cost_per_record FROM usage_events GROUP BY ROLLUP (event_type, pipeline_id)""")
def us06(spark, d):
    return U.cost_rollup(S.usage_events(spark, d)).withColumn("cost", F.col("cost").cast("double"))


# -- billing ---------------------------------------------------------------

@query("bi01_plans", """
SELECT a.tenant_id, p.plan_id, fee::double AS fee, p.event_type, included::bigint AS included, rate::double AS rate FROM accounts a JOIN plans p USING (plan_id)""")
def bi01(spark, d):
    rows = S.accounts(spark, d).select("tenant_id", F.col("plan_id").alias("mine"), F.inline(F.filter(U.plan_rows(), lambda r: r["plan_id"] == F.col("plan_id"))))
    return rows.select("tenant_id", "plan_id", F.col("base_monthly_fee").cast("double").alias("fee"), F.col("metric").alias("event_type"), "included", F.col("overage_rate").cast("double").alias("rate"))


add_view("invoiced", """
SELECT tenant_id, plan_id, base_fee, usage_cost, base_fee + usage_cost AS subtotal, round((base_fee + usage_cost) * 0.08, 2)::decimal(18,2) AS tax, lines FROM (
SELECT a.tenant_id, a.plan_id, (CASE WHEN a.billing_period = 'annual' THEN f.fee * 10.8 ELSE f.fee END)::decimal(18,2) AS base_fee, coalesce(u.c, 0)::decimal(18,2) AS usage_cost, coalesce(u.n, 0) AS lines
FROM accounts a JOIN (SELECT DISTINCT plan_id, fee FROM plans) f USING (plan_id) LEFT JOIN (SELECT tenant_id, sum(line_cost) AS c, count(*) FILTER (WHERE line_cost > 0) AS n FROM billed GROUP BY 1) u ON u.tenant_id = a.tenant_id)""")


def invoices(spark, d):
    return U.invoices(U.usage_by(S.usage_events(spark, d), "tenant_id"), S.accounts(spark, d), END)


@query("bi02_invoices", """
SELECT tenant_id, plan_id, base_fee::double AS base_fee, usage_cost::double AS total_usage_cost, subtotal::double AS subtotal, tax::double AS tax_amount, (subtotal + tax)::double AS total_amount, lines FROM invoiced""")
def bi02(spark, d):
    out = invoices(spark, d)
    return out.select(
        "tenant_id", "plan_id", *[F.col(c).cast("double").alias(c) for c in ("base_fee", "total_usage_cost", "subtotal", "tax_amount", "total_amount")],
        F.coalesce(F.size("usage_charges"), F.lit(0)).cast("bigint").alias("lines"),
    )


@query("bi02_invoice_lines", "SELECT tenant_id, event_type, overage::double AS overage, rate::double AS unit_price, line_cost::double AS line_cost FROM billed WHERE overage > 0")
def bi02_lines(spark, d):
    out = U.charges(U.usage_by(S.usage_events(spark, d), "tenant_id"), S.accounts(spark, d)).where("overage > 0")
    return out.select("tenant_id", "event_type", *[F.col(c).cast("double").alias(c) for c in ("overage", "unit_price", "line_cost")])


@query("bi03_billing_cycle", """
SELECT tenant_id, current_period_end < DATE '2024-02-01' AS due, strftime(CASE WHEN billing_period = 'monthly' THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END, '%Y-%m-%d') AS period_start,
  CASE WHEN billing_period = 'monthly' THEN '2024-02-29' ELSE '2024-12-31' END AS period_end, CASE WHEN billing_period = 'monthly' THEN '2024-03-01' ELSE '2025-01-01' END AS next_billing FROM accounts""")
def bi03(spark, d):
    out = U.next_period(S.accounts(spark, d), END)
    return out.select(
        "tenant_id", "due", F.date_format("current_period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("current_period_end", "yyyy-MM-dd").alias("period_end"), F.date_format("next_billing_date", "yyyy-MM-dd").alias("next_billing"),
    )


@query("bi04_billing_view", """
SELECT b.tenant_id, b.event_type, round(q::double / included * 100, 6) AS usage_percentage, (i.subtotal + i.tax)::double AS last_invoice FROM billed b JOIN invoiced i USING (tenant_id)""")
def bi04(spark, d):
    use = U.with_plan(U.usage_by(S.usage_events(spark, d), "tenant_id"), S.accounts(spark, d))
    bills = invoices(spark, d).select("tenant_id", F.col("total_amount").cast("double").alias("last_invoice"))
    return use.join(bills, "tenant_id").select("tenant_id", "event_type", F.round(U.usage_percentage(), 6).alias("usage_percentage"), "last_invoice")

add_view("period_invoices", """
SELECT tenant_id, period_start, subtotal + round(subtotal * 0.08, 2)::decimal(18,2) AS total_amount, row_number() OVER (PARTITION BY tenant_id ORDER BY period_start DESC) AS position FROM (
SELECT tenant_id, period_start, (CASE WHEN any_value(billing_period) = 'annual' THEN any_value(fee) * 10.8 ELSE any_value(fee) END)::decimal(18,2) + sum(round(greatest(q - included, 0) * rate, 2)::decimal(18,2)) AS subtotal
FROM (SELECT u.tenant_id, u.event_type, a.plan_id, a.billing_period, (DATE '2024-01-01' + (date_diff('day', DATE '2024-01-01', u.timestamp::date) // 4 * 4)::int)::date AS period_start, sum(quantity) AS q
  FROM usage_events u JOIN accounts a USING (tenant_id) GROUP BY 1, 2, 3, 4, 5) JOIN plans USING (plan_id, event_type) GROUP BY 1, 2)""")


def billing(spark, d):
    return U.billing_view(S.usage_events(spark, d), S.accounts(spark, d), 4)


@query("bi04_recent_invoices", """
SELECT tenant_id, position::int AS position, 'inv_' || tenant_id || '_' || strftime(period_start, '%Y%m%d') AS invoice_id, strftime(period_start, '%Y-%m-%d') AS period_start,
  strftime(period_start + 3, '%Y-%m-%d') AS period_end, total_amount::double AS total_amount FROM period_invoices WHERE position <= 5""")
def bi04_recent(spark, d):
    """The five newest invoices of each account, billed every four days."""
    return billing(spark, d).select("tenant_id", F.inline("recent_invoices")).select(
        "tenant_id", "position", "invoice_id", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), F.col("total_amount").cast("double").alias("total_amount"))


@query("bi04_account", """
SELECT a.tenant_id, a.plan_id, a.billing_period, strftime(a.current_period_start, '%Y-%m-%d') AS period_start, strftime(a.current_period_end, '%Y-%m-%d') AS period_end,
  strftime(a.current_period_end + 1, '%Y-%m-%d') AS next_billing, any_value(f.fee)::double AS fee, b.event_type AS metric, any_value(q)::double AS used, any_value(b.included)::bigint AS included,
  round(any_value(q)::double / any_value(b.included) * 100, 6) AS percentage, any_value(i.n)::int AS invoices
FROM accounts a JOIN plans f USING (plan_id) JOIN billed b ON b.tenant_id = a.tenant_id JOIN (SELECT tenant_id, count(*) AS n FROM period_invoices WHERE position <= 5 GROUP BY 1) i ON i.tenant_id = a.tenant_id GROUP BY 1, 2, 3, 4, 5, 6, 8""")
def bi04_account(spark, d):
    """Account, period and plan beside each metric's use of its limit."""
    day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    rows = billing(spark, d).withColumn("invoices", F.size("recent_invoices"))
    return rows.select("*", F.inline("usage")).select(
        "tenant_id", "plan_id", "billing_period", day("current_period_start", "period_start"), day("current_period_end", "period_end"),
        day("next_billing_date", "next_billing"), F.col("base_monthly_fee").cast("double").alias("fee"), "metric",
        F.col("quantity").cast("double").alias("used"), F.col("included").cast("bigint").alias("included"),
        F.round("percentage", 6).alias("percentage"), "invoices")


@query("tk05_last_five", """
SELECT pipeline_id, event_id, r::int AS position FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, event_id DESC) AS r FROM runs) WHERE r <= 5""")
def tk05(spark, d):
    """Newest five per key; the rank filter runs per task before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy("pipeline_id").orderBy(F.desc("started_at"), F.desc("event_id"))
    return S.runs(spark, d).withColumn("position", F.row_number().over(w)).where("position <= 5").select("pipeline_id", "event_id", "position")


@query("tk06_ordered_history", f"""
SELECT {sql_stamp('timestamp')} AS at, event_id, rule FROM rule_alerts WHERE severity = 'critical'""")
def tk06(spark, d):
    raised = AL.check_rules(S.metrics(spark, d), ALL_RULES).where("severity = 'critical'")
    return raised.orderBy(F.desc("timestamp"), "event_id", "rule").select(stamp("timestamp", "at"), "event_id", "rule")
