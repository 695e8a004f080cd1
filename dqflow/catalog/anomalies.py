"""Registered queries: anomaly detectors and reports (AN, WN01, WN06, TK03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import add_view, query
from dqflow.operators import anomaly as A
from dqflow.operators import multivariate as MV


def flat(df, *context, digits=4):
    return df.select(
        "anomaly_type", "severity", "field_name", F.round("score", 6).alias("score"), "affected_records", "threshold", "detection_method",
        *[F.round(F.col("context")[c], digits).alias(c) for c in context],
    )


def numbers(spark, d):
    li = S.table(spark, d, "lineitem")
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


_BAND = "CASE WHEN pct > {0} THEN 'critical' WHEN pct > {1} THEN 'high' WHEN pct > {2} THEN 'medium' ELSE 'low' END"


def _zsql(f, t):
    return f"""SELECT 'statistical_outlier' AS anomaly_type, {_BAND.format(10, 5, 1)} AS severity, '{f}' AS field_name, round(pct / 10, 6) AS score, k AS affected_records, 3.0::double AS threshold,
  'z_score' AS detection_method, round(m, 1) AS mean, round(s, 1) AS stddev FROM (SELECT *, k * 100.0::double / n AS pct FROM (
  SELECT count({f}) AS n, any_value(m) AS m, any_value(s) AS s, count(*) FILTER (WHERE abs(({f}::double - m) / s) > 3) AS k FROM {t}, (SELECT avg({f}::double) AS m, stddev_samp({f}::double) AS s FROM {t}))) WHERE k > 0"""


@query("an01_zscore", _zsql("claim_amount", "claims") + " UNION ALL " + _zsql("value", "events"))
def an01(spark, d):
    c = A.z_score(S.claims(spark, d), "claims", ["claim_amount"])
    return flat(c.unionByName(A.z_score(S.events(spark, d), "events", ["value"])), "mean", "stddev", digits=1)


def _iqrsql(f, t):
    return f"""SELECT 'statistical_outlier' AS anomaly_type, {_BAND.format(15, 8, 3)} AS severity, '{f}' AS field_name, round(least(10.0::double, pct / 2), 6) AS score, k AS affected_records, 1.5::double AS threshold,
  'iqr' AS detection_method, round(q1, 4) AS q1, round(q3, 4) AS q3 FROM (SELECT *, k * 100.0::double / n AS pct FROM (SELECT count({f}) AS n, any_value(q1) AS q1, any_value(q3) AS q3,
  count(*) FILTER (WHERE {f}::double < q1 - 1.5 * (q3 - q1) OR {f}::double > q3 + 1.5 * (q3 - q1)) AS k FROM {t}, (SELECT quantile_cont({f}::double, .25) AS q1, quantile_cont({f}::double, .75) AS q3 FROM {t}))) WHERE k > 0"""


@query("an02_iqr", _iqrsql("claim_amount", "claims") + " UNION ALL " + _iqrsql("value", "events"))
def an02(spark, d):
    c = A.iqr(S.claims(spark, d), "claims", ["claim_amount"])
    return flat(c.unionByName(A.iqr(S.events(spark, d), "events", ["value"])), "q1", "q3")


add_view("hourly", """SELECT hour, volume, prev, CASE WHEN prev > 0 THEN abs(volume - prev) / prev::double ELSE 0.0 END AS change FROM (
SELECT *, lag(volume) OVER (ORDER BY hour) AS prev FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS volume FROM events GROUP BY 1))""")


@query("wn01_hourly_lag", "SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, volume, prev AS previous, change FROM hourly")
def wn01(spark, d):
    return A.hourly_change(S.events(spark, d), "ts").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("an03_volume_change", """
SELECT 'volume_anomaly' AS anomaly_type, CASE WHEN change > .8 THEN 'critical' WHEN change > .6 THEN 'high' WHEN change > .4 THEN 'medium' ELSE 'low' END AS severity, 'record_volume' AS field_name,
  round(least(10.0::double, change * 10), 6) AS score, volume AS affected_records, .5::double AS threshold, 'volume_change' AS detection_method, round(prev::double, 4) AS previous_volume FROM hourly WHERE change > .5""")
def an03(spark, d):
    return flat(A.volume_change(S.events(spark, d), "events", "ts"), "previous_volume")


add_view("seasonal", """SELECT e.event_id, CASE WHEN s > 0 THEN abs(value - m) / s END AS z FROM events e
JOIN (SELECT hour(ts) AS h, dayofweek(ts) AS w, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1, 2) b ON b.h = hour(e.ts) AND b.w = dayofweek(e.ts)""")


@query("wn06_seasonal_scores", "SELECT event_id, round(z, 6) AS z FROM seasonal")
def wn06(spark, d):
    return A.seasonal_scores(S.events(spark, d), "ts", "value").select("event_id", F.round("seasonal_z", 6).alias("z"))


@query("an04_seasonal", """
SELECT 'temporal_anomaly' AS anomaly_type, CASE WHEN dev > 5 OR pct > 10 THEN 'high' WHEN dev > 3 OR pct > 5 THEN 'medium' ELSE 'low' END AS severity, 'value' AS field_name, round(least(10.0::double, dev), 6) AS score,
  k AS affected_records, 2.5::double AS threshold, 'seasonal_analysis' AS detection_method, round(pct, 4) AS anomaly_percentage
FROM (SELECT count(*) FILTER (WHERE z > 2.5) AS k, avg(z) FILTER (WHERE z > 2.5) AS dev, count(*) FILTER (WHERE z > 2.5) * 100.0::double / count(*) AS pct FROM seasonal) WHERE k > 0""")
def an04(spark, d):
    return flat(A.seasonal(S.events(spark, d), "events", "ts", "value"), "anomaly_percentage")


def _domain(method, severity, field, score, k, threshold):
    return f"SELECT 'healthcare_specific' AS anomaly_type, '{severity}' AS severity, '{field}' AS field_name, round(least(10.0::double, {score}), 6) AS score, {k} AS affected_records, {threshold}::double AS threshold, '{method}' AS detection_method"


@query("an05_zero_claims", f"""
{_domain('zero_claims_analysis', 'high', 'claim_amount', 'pct / 2', 'k', '1.0')} FROM (SELECT count(*) FILTER (WHERE claim_amount = 0) AS k, count(*) FILTER (WHERE claim_amount = 0) * 100.0::double / count(*) AS pct FROM claims) WHERE pct > 1""")
def an05(spark, d):
    return flat(A.zero_amount(S.claims(spark, d), "claims", limit=1.0))


@query("an06_high_claims", f"""
{_domain('high_claims_analysis', 'medium', 'claim_amount', 'pct * 2', 'k', '3.0')} FROM (SELECT count(*) FILTER (WHERE c >= 10 AND s > 0 AND claim_amount::double > m + 3 * s) AS k,
  count(*) FILTER (WHERE c >= 10 AND s > 0 AND claim_amount::double > m + 3 * s) * 100.0::double / count(*) AS pct
  FROM claims JOIN (SELECT procedure_code, avg(claim_amount::double) AS m, stddev_samp(claim_amount::double) AS s, count(*) AS c FROM claims GROUP BY 1) USING (procedure_code)) WHERE pct > .5""")
def an06(spark, d):
    return flat(A.high_amount(S.claims(spark, d), "claims", limit=0.5))


add_view("member_profile", "SELECT member_id, count(*) AS claim_count, sum(claim_amount) AS total_amount, count(DISTINCT provider_npi) AS provider_count FROM claims GROUP BY 1")
_USE = {"an07_excessive_utilization": ("claim_count > 50", 2, "utilization_analysis", "member_utilization", "high", "pct", 50),
        "an08_provider_shopping": ("provider_count > 10", 1, "provider_shopping_analysis", "provider_utilization", "medium", "pct * 2", 10),
        "an09_high_cost_members": ("total_amount > 50000", 1, "high_cost_analysis", "member_cost", "medium", "pct", 50000)}


def _register_use(name, spec):
    cond, limit, method, field, severity, score, threshold = spec
    sql = f"""{_domain(method, severity, field, score, 'k', threshold)} FROM (SELECT count(*) FILTER (WHERE {cond}) AS k, count(*) FILTER (WHERE {cond}) * 100.0::double / count(*) AS pct FROM member_profile) WHERE pct > {limit}"""

    @query(name, sql)
    def run(spark, d):
        return flat(A.utilization(S.claims(spark, d), "claims").where(F.col("detection_method") == method))


for _n, _s in _USE.items():
    _register_use(_n, _s)


@query("an10_isolation_forest")
def an10(spark, d):
    return flat(MV.forest_anomalies(numbers(spark, d), "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "anomaly_percentage")


@query("an10_isolation_forest_embeddings")
def an10_embeddings(spark, d):
    dims = S.table(spark, d, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 0
    fields = [f"e{i}" for i in range(dims)]
    e = S.table(spark, d, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(fields)])
    return flat(MV.forest_anomalies(e, "embeddings", fields), "anomaly_percentage")


@query("an10_forest_finds_spikes", """
SELECT count(*) AS total_records, count(*) FILTER (WHERE l_orderkey % 100 = 0 AND l_linenumber = 1) AS spikes, true AS within_contamination, true AS spikes_stand_out FROM lineitem""")
def an10_spikes(spark, d):
    """Checkable facts of the forest: amounts of every hundredth order's first line are raised twentyfold."""
    spike = (F.col("l_orderkey") % 100 == 0) & (F.col("l_linenumber") == 1)
    rows = S.table(spark, d, "lineitem").select(
        spike.cast("long").alias("spikes"), F.col("l_quantity").cast("double").alias("x0"),
        (F.col("l_extendedprice").cast("double") * F.when(spike, 20).otherwise(1)).alias("x1"))
    scored = MV.isolation_scores(rows, ["x0", "x1"], sums=["spikes"]).groupBy("score").agg(F.sum("w").alias("w"), F.sum("spikes").alias("spikes"))
    scored = MV.stored_layer(scored, "spike-scores")  # the model runs once
    limit = MV.exact_percentiles(scored, [], "score", {"_limit": 0.95}, weight="w", interpolate=False).select("_limit").scalar()
    out, w, s = F.col("score") > F.col("_limit"), F.col("w"), F.col("spikes")
    share = F.sum(F.when(out, s)) / F.sum(s), F.sum(F.when(out, w - s)) / F.sum(w - s)
    return scored.withColumn("_limit", limit).agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("total_records"), F.coalesce(F.sum(s), F.lit(0)).alias("spikes"),
        (F.sum(F.when(out, w).otherwise(0)) <= F.sum(w) * 0.05).alias("within_contamination"), (share[0] > 5 * share[1]).alias("spikes_stand_out"))


# Distinct standardised points; neighbours by an equi-join of grid cells of side 0.5.
_NOISE = """
WITH rows AS (SELECT claim_amount::double AS a, datediff('day', date_of_service, submission_date)::double AS b FROM claims WHERE claim_amount IS NOT NULL AND date_of_service IS NOT NULL AND submission_date IS NOT NULL),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM rows),
p AS (SELECT CASE WHEN sa > 0 THEN (a - ma) / sa ELSE 0 END AS x, CASE WHEN sb > 0 THEN (b - mb) / sb ELSE 0 END AS y, count(*) AS w FROM rows, m GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER () AS id, floor(x / .5)::bigint AS cx, floor(y / .5)::bigint AS cy FROM p),
near AS (SELECT s.id, t.id AS other, t.w FROM (SELECT id, x, y, cx + dx AS cx, cy + dy AS cy FROM c, range(-1, 2) t1(dx), range(-1, 2) t2(dy)) s JOIN c t USING (cx, cy) WHERE (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) <= .25),
core AS (SELECT id FROM near GROUP BY id HAVING sum(w) >= 5),
k AS (SELECT coalesce(sum(w), 0)::bigint AS k FROM c WHERE id NOT IN (SELECT near.id FROM near JOIN core ON core.id = near.other)),
n AS (SELECT count(*) AS n FROM rows)
"""


@query("an11_noise_count", _NOISE + "SELECT n AS total_records, k AS anomaly_count FROM n, k")
def an11_count(spark, d):
    rows = S.claims(spark, d).select("claim_amount", F.datediff("submission_date", "date_of_service").alias("lag_days"))
    return MV.noise_summary(rows, ["claim_amount", "lag_days"])


@query("an11_density_noise")
def an11(spark, d):
    rows = S.claims(spark, d).select("claim_amount", F.datediff("submission_date", "date_of_service").alias("lag_days"))
    return flat(MV.dbscan_anomalies(rows, "claims", ["claim_amount", "lag_days"]), "anomaly_percentage")


@query("an11_clusters", _NOISE + "SELECT n AS total_records, k AS noise, n - k AS clustered, true AS some_cluster FROM n, k")
def an11_clusters(spark, d):
    """Records in clusters and outside; the cluster numbers themselves are compared with a plain version in the tests."""
    rows = S.claims(spark, d).select("claim_amount", F.datediff("submission_date", "date_of_service").alias("lag_days"))
    w, c = F.col("w"), F.col("cluster")
    return MV.density_clusters(rows, ["claim_amount", "lag_days"]).agg(
        F.sum("w").alias("total_records"), F.coalesce(F.sum(F.when(c.isNull(), w)), F.lit(0)).alias("noise"),
        F.sum(F.when(c.isNotNull(), w)).alias("clustered"), (F.count_distinct("cluster") > 0).alias("some_cluster"))


def findings(spark, d):
    """Everything the engine reports on the event and claim tables except forests."""
    ev = S.events(spark, d).select("ts", "value")
    cl = S.claims(spark, d).select("claim_id", "member_id", "provider_npi", "procedure_code", "claim_amount")
    return A.detect_all(ev, "events", "ts").unionByName(A.detect_all(cl, "claims", multivariate=False))


_ALL = " UNION ALL ".join(
    f"SELECT anomaly_type, severity, affected_records, detection_method, field_name FROM ({sql})"
    for sql in (
        _zsql("claim_amount", "claims"), _zsql("value", "events"), _iqrsql("claim_amount", "claims"), _iqrsql("value", "events"),
        "SELECT 'volume_anomaly' AS anomaly_type, CASE WHEN change > .8 THEN 'critical' WHEN change > .6 THEN 'high' WHEN change > .4 THEN 'medium' ELSE 'low' END AS severity, volume AS affected_records, 'volume_change' AS detection_method, 'record_volume' AS field_name FROM hourly WHERE change > .5",
        "SELECT 'temporal_anomaly' AS anomaly_type, CASE WHEN dev > 5 OR pct > 10 THEN 'high' WHEN dev > 3 OR pct > 5 THEN 'medium' ELSE 'low' END AS severity, k AS affected_records, 'seasonal_analysis' AS detection_method, 'value' AS field_name FROM (SELECT count(*) FILTER (WHERE z > 2.5) AS k, avg(z) FILTER (WHERE z > 2.5) AS dev, count(*) FILTER (WHERE z > 2.5) * 100.0::double / count(*) AS pct FROM seasonal) WHERE k > 0",
        "SELECT 'healthcare_specific' AS anomaly_type, 'high' AS severity, k AS affected_records, 'utilization_analysis' AS detection_method, 'member_utilization' AS field_name FROM (SELECT count(*) FILTER (WHERE claim_count > 50) AS k, count(*) AS n FROM member_profile) WHERE k * 100.0 / n > 2",
        "SELECT 'healthcare_specific' AS anomaly_type, 'medium' AS severity, k AS affected_records, 'provider_shopping_analysis' AS detection_method, 'provider_utilization' AS field_name FROM (SELECT count(*) FILTER (WHERE provider_count > 10) AS k, count(*) AS n FROM member_profile) WHERE k * 100.0 / n > 1",
        "SELECT 'healthcare_specific' AS anomaly_type, 'medium' AS severity, k AS affected_records, 'high_cost_analysis' AS detection_method, 'member_cost' AS field_name FROM (SELECT count(*) FILTER (WHERE total_amount > 50000) AS k, count(*) AS n FROM member_profile) WHERE k * 100.0 / n > 1",
    )
)
add_view("findings", _ALL)


@query("an12_detection_summary", """
SELECT grouping, name, count(*) AS anomalies, sum(affected_records)::bigint AS affected_records FROM (
SELECT 'type' AS grouping, anomaly_type AS name, affected_records FROM findings UNION ALL SELECT 'severity', severity, affected_records FROM findings UNION ALL SELECT 'all', 'total', affected_records FROM findings) GROUP BY 1, 2""")
def an12(spark, d):
    return A.summary(findings(spark, d))


add_view("claims_lag", "SELECT claim_amount, datediff('day', date_of_service, submission_date) AS lag_days FROM claims")


@query("an12_all_methods", " UNION ALL ".join(
    f"SELECT detection_method, field_name, affected_records, true AS within FROM ({sql})" for sql in (
        _zsql("claim_amount", "claims_lag"), _zsql("lag_days", "claims_lag"), _iqrsql("claim_amount", "claims_lag"), _iqrsql("lag_days", "claims_lag"))) + f"""
UNION ALL SELECT * FROM ({_NOISE} SELECT 'dbscan', 'claim_amount,lag_days', k, true FROM k WHERE k > 0)
UNION ALL SELECT 'isolation_forest', 'claim_amount,lag_days', NULL, count(*) >= 100 FROM claims_lag WHERE claim_amount IS NOT NULL AND lag_days IS NOT NULL""")
def an12_methods(spark, d):
    """Every detector over a table of two numbers; the forest's count is held against its contamination of a tenth."""
    rows = S.claims(spark, d).select("claim_amount", F.datediff("submission_date", "date_of_service").alias("lag_days"))
    forest = F.col("detection_method") == "isolation_forest"
    share = F.col("context")["anomaly_percentage"]
    return A.detect_all(rows, "amounts").select(
        "detection_method", "field_name", F.when(~forest, F.col("affected_records")).alias("affected_records"),
        F.when(forest, (share > 0) & (share <= 10)).otherwise(True).alias("within"))


@query("an14_top_findings", """
SELECT anomaly_type, severity, affected_records FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, affected_records DESC) AS r FROM (
 SELECT 'volume_anomaly' AS anomaly_type, CASE WHEN change > .8 THEN 'critical' WHEN change > .6 THEN 'high' WHEN change > .4 THEN 'medium' ELSE 'low' END AS severity, volume AS affected_records FROM hourly WHERE change > .5)) WHERE r <= 20""")
def an14(spark, d):
    rows = A.volume_change(S.events(spark, d), "events", "ts")
    return rows.orderBy(A.severity_rank(), F.desc("affected_records"), "anomaly_id").limit(20).select("anomaly_type", "severity", "affected_records")


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_METHOD_ADVICE = (
    ("z_score", 1, "Look up the rows far from the mean and where they were keyed in"),
    ("z_score", 2, "Keep them if they are real: a few large values may be the business"),
    ("iqr", 1, "Compare the rows outside the fences with the rest by source"),
    ("iqr", 2, "A long tail may call for a logarithm before fences are drawn"),
    ("volume_change", 1, "See which feeds delivered more or fewer rows in this hour"),
    ("volume_change", 2, "Look for repeated or missing files around it"),
    ("seasonal_analysis", 1, "Compare with the same hour of other weeks"),
    ("seasonal_analysis", 2, "Holidays and one-off loads shift the hourly baseline"),
    ("utilization_analysis", 1, "Read the claim history of the busiest members"),
    ("utilization_analysis", 2, "Rule out repeated submissions before suspecting misuse"),
    ("provider_shopping_analysis", 1, "See how many providers billed one member for one condition"),
    ("provider_shopping_analysis", 2, "Shared practices may explain several identifiers"),
    ("high_cost_analysis", 1, "Split the total of each costly member by procedure"),
)
_ADVICE_ROWS = ", ".join(f"('{m}', {i}, '{t}')" for m, i, t in _METHOD_ADVICE)


@query("an14_report", f"""
SELECT 'by severity' AS section, severity AS name, NULL::int AS position, count(*) AS value FROM findings GROUP BY 2
UNION ALL SELECT 'by anomaly_type', anomaly_type, NULL, count(*) FROM findings GROUP BY 2
UNION ALL SELECT 'top', severity || ' ' || detection_method || ' ' || field_name, r::int, affected_records FROM (
  SELECT *, row_number() OVER (ORDER BY {_RANK}, affected_records DESC) AS r FROM findings) WHERE r <= 20
UNION ALL SELECT 'advice', text, i::int, count(*) FROM findings JOIN (VALUES {_ADVICE_ROWS}) a(m, i, text) ON m = detection_method GROUP BY 2, 3""")
def an14_report(spark, d):
    """The report over everything the detectors found: counts, the first findings with their fields, advice."""
    return A.report(findings(spark, d))


@query("an15_report_rollup", """
SELECT anomaly_type, severity, count(*) AS anomalies, sum(affected_records)::bigint AS affected_records, round(count(*) * 100.0::double / (SELECT count(*) FROM claims), 6) AS rate_percentage FROM findings GROUP BY 1, 2""")
def an15(spark, d):
    n = S.claims(spark, d).agg(F.count("*")).scalar()
    return A.report_rollup(findings(spark, d), n).withColumn("rate_percentage", F.round("rate_percentage", 6))


@query("tk03_top_findings", """
SELECT severity, count(*) AS n FROM (SELECT severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS r FROM findings) WHERE r <= 20 GROUP BY 1""")
def tk03(spark, d):
    return A.top_findings(findings(spark, d)).groupBy("severity").agg(F.count("*").alias("n"))


@query("an16_volume_bands", """
SELECT strftime(day, '%Y-%m-%d') AS day, records, baseline, CASE WHEN baseline IS NULL THEN 'no_baseline' WHEN c > .5 THEN 'critical' WHEN c > .25 THEN 'warning' WHEN c > .1 THEN 'unusual' ELSE 'expected' END AS band
FROM (SELECT *, abs(records - baseline) / baseline AS c FROM (SELECT day, records, sum(records) OVER w / (count(*) OVER w)::double AS baseline FROM (SELECT ts::date AS day, count(*) AS records FROM events GROUP BY 1)
 WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)))""")
def an16(spark, d):
    out = A.volume_bands(S.events(spark, d), F.to_date("ts"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "records", "baseline", "band")
