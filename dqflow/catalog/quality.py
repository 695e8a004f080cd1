"""Registered queries: rules, scores, profiles, remediation (QA, RM, UD, TK, SF08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import add_view, query
from dqflow.functions import codes as C
from dqflow.operators import assess as A
from dqflow.operators import profile as P
from dqflow.operators import remediate as R
from dqflow.operators import scores as SC
from dqflow.operators.rules import Rule, RuleSet, bind_names, glob_column, registry_state

AS_OF = S.CLAIMS_AS_OF
FIELDS = (
    "claim_id", "member_id", "provider_npi", "diagnosis_code", "procedure_code", "date_of_service", "claim_amount",
    "place_of_service", "claim_status", "created_date",
)


def assessed(spark, d):
    return S.claims_feed(spark, d).select(*FIELDS)


def rules():
    """Built-in rules plus cross-field and business rules for the other dimensions."""
    return RuleSet.builtin(AS_OF).with_rules(
        [
            Rule("created_before_service", "consistency", "warning", "field_value <= date_add(date_of_service, 3000)", ("created_date",)),
            Rule("known_status", "consistency", "warning", "upper(field_value) IN ('SUBMITTED','PROCESSING','PAID','DENIED','PENDING')", ("claim_status",)),
            Rule("reasonable_amount", "accuracy", "warning", "field_value BETWEEN 1 AND 100000", ("claim_amount",), threshold=90.0),
            Rule("recent_claim", "timeliness", "warning", "field_value >= DATE '1996-06-01'", ("created_date",)),
        ]
    )


def settled(spark, d):
    return A.settled_results(assessed(spark, d), rules())


_NPI_OK = """(SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN g * 2 > 9 THEN g * 2 - 9 ELSE g * 2 END ELSE g END) % 10 = 0
  FROM (SELECT i, substr(reverse('80840' || provider_npi), (i + 1)::int, 1)::int AS g FROM range(15) t(i)))"""
_TEXT = ("claim_id", "member_id", "provider_npi", "diagnosis_code", "procedure_code", "place_of_service", "claim_status")
_CONDS = (
    [(f, "null_completeness", "completeness", "critical", f"{f} IS NOT NULL") for f in FIELDS]
    + [(f, "blank_completeness", "completeness", "warning", f"trim({f}) <> ''") for f in _TEXT]
    + [(f, "date_range", "validity", "critical", f"{f} BETWEEN DATE '1900-01-01' AND DATE '2002-12-01'") for f in ("date_of_service", "created_date")]
    + [
        ("provider_npi", "npi_format", "validity", "critical", f"provider_npi IN (SELECT provider_npi FROM (SELECT DISTINCT provider_npi FROM claims) WHERE {_NPI_OK})"),
        ("diagnosis_code", "icd10_format", "validity", "critical", "regexp_matches(diagnosis_code, '^[A-TV-Z][0-9][A-Z0-9](\\.[A-Z0-9]{0,4})?$')"),
        ("procedure_code", "cpt_format", "validity", "critical", "regexp_matches(procedure_code, '^[0-9]{5}$')"),
        ("created_date", "created_before_service", "consistency", "warning", "created_date <= date_of_service + 3000"),
        ("claim_status", "known_status", "consistency", "warning", "claim_status IN ('SUBMITTED','PROCESSING','PAID','DENIED','PENDING')"),
        ("claim_amount", "reasonable_amount", "accuracy", "warning", "claim_amount BETWEEN 1 AND 100000"),
        ("created_date", "recent_claim", "timeliness", "warning", "created_date >= DATE '1996-06-01'"),
    ]
)
_UNIQUE = ("claim_id", "member_id")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE {c[4]}) AS c{i}" for i, c in enumerate(_CONDS))
_ROWS = ", ".join(f"('{c[0]}', '{c[1]}', '{c[2]}', '{c[3]}', c{i}, {90.0 if c[1] == 'reasonable_amount' else 'NULL'}::double)" for i, c in enumerate(_CONDS))
_UROWS = " UNION ALL ".join(
    f"SELECT '{f}', 'primary_key_uniqueness', 'uniqueness', 'critical', CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT {f} FROM claims_feed)) = n THEN n ELSE 0 END, NULL, n FROM (SELECT count(*) AS n FROM claims_feed)"
    for f in _UNIQUE
)
add_view("rule_rows", f"""
SELECT v.field, v.rule, v.dimension, v.severity, v.passed_count, v.threshold, n FROM (SELECT count(*) AS n, {_COUNTS} FROM claims_feed),
LATERAL (VALUES {_ROWS}) v(field, rule, dimension, severity, passed_count, threshold)
UNION ALL {_UROWS}""")
add_view("rule_results", """
SELECT field, rule, dimension, severity, passed_count, n - passed_count AS violation_count, n AS total_count,
  passed_count::double / n * 100 AS score, n = passed_count OR coalesce(passed_count::double / n * 100 >= threshold, false) AS passed FROM rule_rows""")
add_view("field_dims", "SELECT field, dimension, avg(score) AS score FROM rule_results GROUP BY 1, 2")
add_view("dim_scores", """
SELECT d.dimension, d.w, coalesce(s.score, 100.0) AS score FROM (VALUES ('completeness', .25::double), ('validity', .3), ('consistency', .2), ('accuracy', .15), ('timeliness', .1), ('uniqueness', .2)) d(dimension, w)
LEFT JOIN (SELECT dimension, avg(score) AS score FROM field_dims GROUP BY 1) s USING (dimension)""")
add_view("overall", "SELECT sum(score * w) / sum(w) AS overall_score FROM dim_scores")


@query("qa01_registry", """
SELECT column_name AS field, CASE WHEN column_name IN ('claim_id', 'member_id') THEN 1 ELSE 0 END AS unique_rules, true AS null_rule
FROM (SELECT unnest(['claim_id','member_id','provider_npi','diagnosis_code','procedure_code','date_of_service','claim_amount','place_of_service','claim_status','created_date']) AS column_name)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def qa01(spark, d):
    """Register, replace, unregister and disable rules, then list the binding per column."""
    rs = RuleSet.builtin(AS_OF).register(Rule("extra", "validity", "info", "true", ("*",))).unregister("extra").enable("phone_format", False)
    df = assessed(spark, d)
    bound = rs.bind(df.schema)
    lookup = F.create_map(
        *[x for f in df.columns for x in (F.lit(f), F.struct(
            F.lit(sum(1 for g, r in bound if g == f and r.dimension == "uniqueness")).alias("u"),
            F.lit(any(g == f and r.name == "null_completeness" for g, r in bound)).alias("n")))]
    )
    used = df.agg(*[F.count(F.lit(1)).alias(f) for f in df.columns])
    names = used.select(F.explode(F.array(*[F.when(F.col(f) > 0, F.lit(f)) for f in df.columns])).alias("field")).where("field IS NOT NULL")
    return names.select("field", lookup[F.col("field")].alias("l")).select("field", F.col("l.u").alias("unique_rules"), F.col("l.n").alias("null_rule"))


_COMMANDS = """SELECT 'rule' || (user_id % 40) AS rule, event_id AS seq,
  CASE event_id % 7 WHEN 0 THEN 'unregister' WHEN 1 THEN 'disable' WHEN 2 THEN 'enable' ELSE 'register' END AS action,
  CASE event_id % 5 WHEN 0 THEN '*' WHEN 1 THEN 'SRC' || (user_id % 10) || '*' WHEN 2 THEN '*' || (user_id % 10) WHEN 3 THEN '*c' || (user_id % 4) || '*' ELSE 'src' || (user_id % 20) END AS pattern
FROM events"""


@query("qa01_registry_log", f"""
WITH c AS ({_COMMANDS}), p AS (SELECT * FROM c WHERE action IN ('register', 'unregister') QUALIFY row_number() OVER (PARTITION BY rule ORDER BY seq DESC) = 1),
s AS (SELECT * FROM c WHERE action IN ('enable', 'disable') QUALIFY row_number() OVER (PARTITION BY rule ORDER BY seq DESC) = 1),
r AS (SELECT p.rule, replace(lower(p.pattern), '*', '%') AS g FROM p LEFT JOIN s USING (rule) WHERE p.action = 'register' AND (s.seq IS NULL OR s.seq < p.seq OR s.action = 'enable'))
SELECT rule, name FROM r JOIN (SELECT DISTINCT source AS name FROM documents) ON lower(name) LIKE g""")
def qa01_log(spark, d):
    """A registry folded from a log of commands, one per event, bound to the names found in the documents."""
    event, user = F.col("event_id"), F.col("user_id")
    pick = lambda n, *c: F.get(F.array(*c), (event % n).cast("int"))
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    commands = S.table(spark, d, "events").select(
        text("rule", (user % 40).cast("string")).alias("rule"), event.alias("at"),
        F.coalesce(pick(7, F.lit("unregister"), F.lit("disable"), F.lit("enable")), F.lit("register")).alias("action"),
        pick(5, F.lit("*"), text("SRC", (user % 10).cast("string"), "*"), text("*", (user % 10).cast("string")),
             text("*c", (user % 4).cast("string"), "*"), text("src", (user % 20).cast("string"))).alias("pattern"))
    return bind_names(registry_state(commands), S.table(spark, d, "documents").select(F.col("source").alias("name")))


@query("qa02_binding", """
SELECT pattern, count(*) AS documents FROM documents, (VALUES ('*'), ('*1*'), ('*9'), ('src1*'), ('SRC7')) p(pattern)
WHERE CASE pattern WHEN '*' THEN true WHEN '*1*' THEN contains(source, '1') WHEN '*9' THEN source LIKE '%9'
  WHEN 'src1*' THEN source LIKE 'src1%' ELSE source = 'src7' END GROUP BY 1""")
def qa02(spark, d):
    """Glob patterns matched against names found in the data."""
    src = S.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    pats = ["*", "*1*", "*9", "src1*", "SRC7"]
    hits = F.array_compact(F.array(*[F.when(glob_column(p, F.col("source")), F.lit(p)) for p in pats]))
    return src.select(F.explode(hits).alias("pattern"), "n").groupBy("pattern").agg(F.sum("n").alias("documents"))


@query("qa03_builtin_rules", """
SELECT rule, sum(violation_count)::bigint AS violations FROM rule_results
WHERE rule IN ('null_completeness', 'blank_completeness', 'date_range', 'npi_format', 'icd10_format', 'cpt_format', 'primary_key_uniqueness') GROUP BY 1""")
def qa03(spark, d):
    return A.rule_results(assessed(spark, d), RuleSet.builtin(AS_OF)).groupBy("rule").agg(F.sum("violation_count").alias("violations"))


@query("qa04_rule_results", """
SELECT field, rule, dimension, severity, passed_count, violation_count, total_count, round(score, 6) AS score, passed FROM rule_results""")
def qa04(spark, d):
    return A.rule_results(assessed(spark, d), rules()).select(
        "field", "rule", "dimension", "severity", "passed_count", "violation_count", "total_count", F.round("score", 6).alias("score"), "passed"
    )


@query("qa05_uniqueness", """
SELECT field, total, distinct_values, round((total - distinct_values)::double / total, 6) AS duplicate_rate,
  CASE WHEN (total - distinct_values)::double / total > .1 THEN 'critical' WHEN (total - distinct_values)::double / total > .05 THEN 'warning'
    WHEN (total - distinct_values)::double / total > .01 THEN 'acceptable' ELSE 'target' END AS band, total = distinct_values AS passed
FROM (SELECT 'claim_id' AS field, count(*) AS total, (SELECT count(*) FROM (SELECT DISTINCT claim_id FROM claims_feed)) AS distinct_values FROM claims_feed
  UNION ALL SELECT 'member_id', count(*), (SELECT count(*) FROM (SELECT DISTINCT member_id FROM claims_feed)) FROM claims_feed
  UNION ALL SELECT 'k', count(*), (SELECT count(*) FROM (SELECT DISTINCT k FROM claims_feed)) FROM claims_feed)""")
def qa05(spark, d):
    r = (F.col("total") - F.col("distinct_values")) / F.col("total")
    return A.distinct_counts(S.claims_feed(spark, d), ["claim_id", "member_id", "k"]).select(
        "field", "total", "distinct_values", F.round(r, 6).alias("duplicate_rate"), A.band("duplicate_rate", r).alias("band"),
        (F.col("total") == F.col("distinct_values")).alias("passed"),
    )


@query("qa06_field_assessment", """
SELECT f.field, violation_count AS null_count, round(violation_count::double / total_count * 100, 6) AS null_percentage, round(f.s, 6) AS field_score
FROM (SELECT field, avg(score) AS s FROM field_dims GROUP BY 1) f JOIN (SELECT * FROM rule_results WHERE rule = 'null_completeness') r USING (field)""")
def qa06(spark, d):
    res = settled(spark, d)
    return A.field_scores(res).join(A.field_nulls(res), "field").select(
        "field", "null_count", F.round("null_percentage", 6).alias("null_percentage"), F.round("field_score", 6).alias("field_score")
    )


@query("qa07_field_dimensions", "SELECT field, dimension, round(score, 6) AS score FROM field_dims")
def qa07(spark, d):
    return A.field_results(A.rule_results(assessed(spark, d), rules())).select("field", "dimension", F.round("score", 6).alias("score"))


@query("qa08_dimension_scores", "SELECT dimension, round(score, 6) AS score FROM dim_scores")
def qa08(spark, d):
    return A.dimension_scores(A.rule_results(assessed(spark, d), rules())).select("dimension", F.round("score", 6).alias("score"))


@query("qa09_overall_score", "SELECT round(overall_score, 6) AS overall_score FROM overall")
def qa09(spark, d):
    return A.overall_score(A.dimension_scores(A.rule_results(assessed(spark, d), rules()))).select(
        F.round("overall_score", 6).alias("overall_score")
    )


_ISSUES = """
SELECT CASE WHEN overall_score < 60 THEN 'critical_overall_quality' ELSE 'low_overall_quality' END AS type,
  CASE WHEN overall_score < 60 THEN 'critical' ELSE 'warning' END AS severity, NULL::varchar AS field, overall_score AS measured FROM overall WHERE overall_score < 80
UNION ALL SELECT 'low_' || dimension || '_score', 'critical', NULL, score FROM dim_scores WHERE score < 70
UNION ALL SELECT 'high_null_percentage', 'warning', field, violation_count::double / total_count * 100 FROM rule_results
  WHERE rule = 'null_completeness' AND violation_count::double / total_count * 100 > 20"""
add_view("issues", _ISSUES)


@query("qa10_issues", "SELECT type, severity, field, round(measured, 6) AS measured FROM issues")
def qa10(spark, d):
    return A.issues(settled(spark, d)).withColumn("measured", F.round("measured", 6))


_ADVICE = ", ".join(f"({i}, '{a}', {b}, '{t}')" for i, (a, b, t) in enumerate(A.ADVICE))
_CODE_ADVICE = ", ".join(f"({len(A.ADVICE) + i}, '{t}')" for i, t in enumerate(A.CODE_ADVICE))


_ADVISED = f"""
SELECT position, recommendation FROM (VALUES {_ADVICE}) a(position, d, below, recommendation)
JOIN (SELECT dimension, score FROM dim_scores UNION ALL SELECT 'overall', overall_score FROM overall) s ON s.dimension = a.d AND s.score < a.below
UNION ALL SELECT position, recommendation FROM (VALUES {_CODE_ADVICE}) c(position, recommendation)
WHERE (SELECT count(*) FROM issues WHERE regexp_matches(lower(coalesce(field, type)), 'npi|icd|cpt|member|provider')) > 0"""
add_view("advised", _ADVISED)


@query("qa11_recommendations", _ADVISED)
def qa11(spark, d):
    return A.recommendations(settled(spark, d))


@query("qa12_assessment", """
SELECT 'claims' AS table_name, max(total_count) AS record_count, count(DISTINCT field) AS field_count, count(*) AS rule_count,
  count(*) FILTER (WHERE NOT passed) AS failed_rules, (SELECT round(overall_score, 6) FROM overall) AS overall_score,
  (SELECT count(*) FROM issues WHERE severity = 'critical') AS critical_issues,
  (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'completeness') AS completeness, (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'validity') AS validity,
  (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'consistency') AS consistency, (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'accuracy') AS accuracy,
  (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'timeliness') AS timeliness, (SELECT round(score, 6) FROM dim_scores WHERE dimension = 'uniqueness') AS uniqueness
FROM rule_results""")
def qa12(spark, d):
    out = A.summary_row(assessed(spark, d), "claims", rules())
    return out.withColumns({c: F.round(c, 6) for c in ("overall_score", *A.DIMENSIONS)})


@query("qa13_profile", """
SELECT field, total_count, null_count, distinct_count, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, round(mean_value, 1) AS mean_value,
  round(stddev_value, 1) AS stddev_value, round(median_value, 4) AS median_value, n_top FROM (
SELECT 'claim_amount' AS field, count(*) AS total_count, count(*) - count(claim_amount) AS null_count, count(DISTINCT claim_amount) AS distinct_count,
  min(claim_amount)::double AS min_value, max(claim_amount)::double AS max_value, avg(claim_amount::double) AS mean_value, stddev_samp(claim_amount::double) AS stddev_value,
  quantile_cont(claim_amount::double, .5) AS median_value, 10::bigint AS n_top FROM claims_feed
UNION ALL SELECT 'member_id', count(*), count(*) - count(member_id), (SELECT count(*) FROM (SELECT DISTINCT member_id FROM claims_feed)), NULL, NULL, NULL, NULL, NULL, 10 FROM claims_feed
UNION ALL SELECT 'place_of_service', count(*), 0, count(DISTINCT place_of_service), NULL, NULL, NULL, NULL, NULL, count(DISTINCT place_of_service) FROM claims_feed)""")
def qa13(spark, d):
    out = P.profile(assessed(spark, d), ["claim_amount", "member_id", "place_of_service"])
    return out.select(
        "field", "total_count", "null_count",
        "distinct_count",
        *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "median_value")],
        *[F.round(c, 1).alias(c) for c in ("mean_value", "stddev_value")],
        F.size("top_values").cast("bigint").alias("n_top"),
    )


def _pattern_sql(table, field):
    c = f"CASE WHEN {field} <> '' THEN {field} END"
    return f"""SELECT '{field}' AS field, count(c) AS values, coalesce(min(length(c)), 0)::bigint AS min_length, coalesce(max(length(c)), 0)::bigint AS max_length, round(avg(length(c)), 6) AS avg_length,
  count(*) FILTER (WHERE regexp_matches(c, '^[^@]+@[^@]+\\.[^@]+$')) AS email,
  count(*) FILTER (WHERE regexp_matches(c, '^[0-9()+\\s-]+$') AND length(regexp_replace(c, '[^0-9]', '', 'g')) >= 10) AS phone,
  count(*) FILTER (WHERE regexp_matches(regexp_replace(c, '[.-]', '', 'g'), '^[0-9]+$')) AS numeric,
  count(*) FILTER (WHERE regexp_matches(replace(c, ' ', ''), '^[a-zA-Z0-9]+$')) AS alphanumeric,
  count(*) FILTER (WHERE upper(c) = c AND lower(c) <> c) AS uppercase, count(*) FILTER (WHERE lower(c) = c AND upper(c) <> c) AS lowercase FROM (SELECT {c} AS c FROM {table})"""


@query("qa14_patterns", " UNION ALL ".join(_pattern_sql("members", f) for f in ("email", "phone", "gender", "zip_code", "ssn", "last_name")))
def qa14(spark, d):
    out = P.patterns(S.members(spark, d), ["email", "phone", "gender", "zip_code", "ssn", "last_name"])
    return out.withColumn("avg_length", F.round("avg_length", 6))


_Q = "((member_id IS NOT NULL)::int * 2 + (provider_npi IS NOT NULL)::int * 2 + (diagnosis_code IS NOT NULL)::int * 2 + (procedure_code IS NOT NULL)::int * 2 + (claim_amount > 0)::int * 2)"
_A = "CASE WHEN claim_amount > 50000 THEN 9 WHEN claim_amount > 10000 THEN 7 WHEN claim_amount > 5000 THEN 5 WHEN claim_amount > 1000 THEN 3 ELSE 1 END"
add_view("scored", f"SELECT *, {_Q} AS q10, {_A} AS a10, epoch(TIMESTAMP '2001-12-01' - _ingestion_timestamp) / 3600.0 AS fresh FROM raw_claims")


@query("qa15_quality_score", "SELECT claim_id, q10 / 10.0::double AS quality_score FROM scored")
def qa15(spark, d):
    return S.raw_claims(spark, d).select("claim_id", SC.quality_score().alias("quality_score"))


@query("qa16_anomaly_score", "SELECT claim_id, a10 / 10.0::double AS anomaly_score FROM scored")
def qa16(spark, d):
    return S.raw_claims(spark, d).select("claim_id", SC.anomaly_score().cast("double").alias("anomaly_score"))


def scored(spark, d, of_members=None):
    from dqflow.functions.scalars import freshness_hours

    return S.raw_claims(spark, d, of_members).withColumns(
        {
            "_quality_score": SC.quality_score(),
            "_anomaly_score": SC.anomaly_score().cast("double"),
            "_data_freshness_hours": freshness_hours("_ingestion_timestamp", AS_OF),
        }
    )


@query("qa17_business_rule_score", """
SELECT ((q10 >= 8)::int * 4 + (fresh <= 24)::int * 3 + (a10 <= 5)::int * 3) / 10.0::double AS score,
  CASE WHEN a10 > 7 THEN 'high_risk' WHEN a10 > 4 THEN 'medium_risk' ELSE 'low_risk' END AS risk, count(*) AS n FROM scored GROUP BY 1, 2""")
def qa17(spark, d):
    return scored(spark, d).groupBy(SC.business_rule_score().alias("score"), SC.risk_category().alias("risk")).agg(F.count("*").alias("n"))


@query("qa18_dimension_metrics", """
SELECT metric, round(value, 6) AS value, CASE WHEN lower_better THEN CASE WHEN value < good THEN 'good' WHEN value < fair THEN 'fair' ELSE 'poor' END
  ELSE CASE WHEN value > good THEN 'good' WHEN value > fair THEN 'fair' ELSE 'poor' END END AS band FROM (
SELECT v.* FROM (SELECT count(*)::double AS n, count(*) FILTER (WHERE member_id IS NULL) AS a, count(*) FILTER (WHERE trim(member_id) = '') AS b,
  count(*) FILTER (WHERE regexp_matches(diagnosis_code, '^[A-TV-Z][0-9][A-Z0-9](\\.[A-Z0-9]{0,4})?$')) AS c, count(*) FILTER (WHERE claim_amount BETWEEN 1 AND 100000) AS e,
  count(*) FILTER (WHERE submission_date >= date_of_service) AS f, count(*) FILTER (WHERE claim_amount BETWEEN 0 AND 1000000 AND date_of_service IS NOT NULL) AS g, avg(fresh) AS h FROM scored),
LATERAL (VALUES ('null_percentage', a / n * 100, 5.0, 15.0, true), ('blank_percentage', b / n * 100, 3.0, 10.0, true), ('format_compliance', c / n * 100, 95.0, 85.0, false),
 ('range_compliance', e / n * 100, 98.0, 90.0, false), ('cross_field_consistency', f / n * 100, 95.0, 85.0, false), ('business_rule_compliance', g / n * 100, 96.0, 88.0, false), ('data_freshness', h, 6.0, 24.0, true)) v(metric, value, good, fair, lower_better))""")
def qa18(spark, d):
    n = F.count(F.lit(1))

    def share(c):
        return F.count_if(c) / n * 100

    m = {
        "null_percentage": share(F.col("member_id").isNull()),
        "blank_percentage": share(F.trim("member_id") == ""),
        "format_compliance": share(C.is_diagnosis_loose("diagnosis_code")),
        "range_compliance": share(C.is_reasonable_amount("claim_amount")),
        "cross_field_consistency": share(F.col("submission_date") >= F.col("date_of_service")),
        "business_rule_compliance": share(C.is_claim_amount("claim_amount") & F.col("date_of_service").isNotNull()),
        "data_freshness": F.avg("_data_freshness_hours"),
    }
    rows = A.one_pass(scored(spark, d), m)
    band = F.lit(None).cast("string")
    for k in m:
        band = F.when(F.col("key") == k, A.metric_band(k, F.col("value"))).otherwise(band)
    return rows.select(F.col("key").alias("metric"), F.round("value", 6).alias("value"), band.alias("band"))


@query("qa19_cross_table_dimensions", """
SELECT dimension, name, round(100.0 * ok / n, 6) AS score FROM (SELECT count(*)::double AS n,
  count(*) FILTER (WHERE member_id IN (SELECT member_id FROM eligibility)) AS a, count(*) FILTER (WHERE provider_npi IN (SELECT provider_npi FROM providers WHERE status = 'ACTIVE')) AS b,
  count(*) FILTER (WHERE discharge_date >= admission_date) AS c, count(*) FILTER (WHERE submission_date <= date_of_service + 90) AS e FROM claims),
LATERAL (VALUES ('consistency', 'member_exists', a), ('accuracy', 'provider_active', b), ('consistency', 'discharge_after_admission', c), ('timeliness', 'submitted_in_time', e)) v(dimension, name, ok)""")
def qa19(spark, d):
    """Rules fed by other tables enter the assessment as flag columns."""
    from dqflow.operators.skew import flag_member, known
    from dqflow.sources.tables import stored_layer

    days = ("discharge_date", "admission_date", "submission_date", "date_of_service")
    base = stored_layer(S.claims(spark, d).select("member_id", "provider_npi", *days), "cross-table")
    rows = known(base, S.providers(spark, d).where("status = 'ACTIVE'"), "provider_npi", "provider_active").drop("provider_npi")
    rows = flag_member(rows, S.eligibility(spark, d), "member_id", "member_exists", source=base)
    rs = RuleSet(
        {
            r.name: r
            for r in (
                Rule("member_exists", "consistency", "critical", "field_value", ("member_exists",)),
                Rule("provider_active", "accuracy", "warning", "field_value", ("provider_active",)),
                Rule("discharge_after_admission", "consistency", "warning", "field_value >= admission_date", ("discharge_date",)),
                Rule("submitted_in_time", "timeliness", "info", "field_value <= date_add(date_of_service, 90)", ("submission_date",)),
            )
        }
    )
    return A.rule_results(rows, rs).select("dimension", F.col("rule").alias("name"), F.round("score", 6).alias("score"))


@query("qa20_threshold_bands", """
SELECT claim_status, round(c, 6) AS completeness, CASE WHEN c < .7 THEN 'critical' WHEN c < .85 THEN 'warning' WHEN c < .95 THEN 'acceptable' ELSE 'target' END AS completeness_band,
  round(v, 6) AS validity, CASE WHEN v < .75 THEN 'critical' WHEN v < .9 THEN 'warning' WHEN v < .98 THEN 'acceptable' ELSE 'target' END AS validity_band,
  round(h, 6) AS age_hours, CASE WHEN h > 48 THEN 'critical' WHEN h > 24 THEN 'warning' WHEN h > 6 THEN 'acceptable' ELSE 'target' END AS age_band
FROM (SELECT claim_status, count(member_id)::double / count(*) AS c, count(*) FILTER (WHERE regexp_matches(diagnosis_code, '^[A-TV-Z][0-9][A-Z0-9]$'))::double / count(*) AS v, max(fresh) AS h FROM scored GROUP BY 1)""")
def qa20(spark, d):
    g = scored(spark, d).groupBy("claim_status").agg(
        (F.count("member_id") / F.count(F.lit(1))).alias("c"),
        (F.count_if(C.is_diagnosis_loose("diagnosis_code")) / F.count(F.lit(1))).alias("v"),
        F.max("_data_freshness_hours").alias("h"),
    )
    return g.select(
        "claim_status",
        F.round("c", 6).alias("completeness"), A.band("completeness", F.col("c")).alias("completeness_band"),
        F.round("v", 6).alias("validity"), A.band("validity", F.col("v")).alias("validity_band"),
        F.round("h", 6).alias("age_hours"), A.band("data_age_hours", F.col("h")).alias("age_band"),
    )


@query("qa22_matrix", """
SELECT field, round(max(score) FILTER (WHERE dimension = 'completeness'), 6) AS completeness, round(max(score) FILTER (WHERE dimension = 'validity'), 6) AS validity,
  round(max(score) FILTER (WHERE dimension = 'consistency'), 6) AS consistency, round(max(score) FILTER (WHERE dimension = 'accuracy'), 6) AS accuracy,
  round(max(score) FILTER (WHERE dimension = 'timeliness'), 6) AS timeliness, round(max(score) FILTER (WHERE dimension = 'uniqueness'), 6) AS uniqueness FROM field_dims GROUP BY 1""")
def qa22(spark, d):
    out = A.field_dimension_matrix(A.rule_results(assessed(spark, d), rules()))
    return out.select("field", *[F.round(c, 6).alias(c) for c in A.DIMENSIONS])


# -- user functions --------------------------------------------------------

@query("ud01_sql_functions", f"""
SELECT {_NPI_OK} AS npi_ok, regexp_matches(provider_npi, '^[0-9]{{10}}$') AS format_ok, count(*) AS n FROM providers GROUP BY 1, 2""")
def ud01(spark, d):
    from dqflow.operators.rules import register_sql_functions

    register_sql_functions(spark)
    return S.providers(spark, d).groupBy(
        F.expr("is_npi(provider_npi)").alias("npi_ok"), F.expr("standard_phone(provider_npi) = provider_npi").alias("format_ok")
    ).agg(F.count("*").alias("n"))


@query("ud03_config_rules", """
SELECT 'claim_amount' AS field, 'cap' AS rule, count(*) FILTER (WHERE claim_amount <= 50000) AS passed_count, count(*) FILTER (WHERE claim_amount <= 50000)::double / count(*) * 100 >= 40 AS passed FROM claims_feed
UNION ALL SELECT 'member_id', 'optional_member', count(*) FILTER (WHERE member_id IS NULL OR starts_with(member_id, 'M')), true FROM claims_feed
UNION ALL SELECT 'claim_status', 'broken', 0, false""")
def ud03(spark, d):
    """Rules from a plain dict; a condition that does not analyse scores zero."""
    rs = RuleSet().load(
        {
            "cap": {"dimension": "validity", "severity": "info", "condition": "field_value <= 50000", "field_names": ["claim_amount"], "threshold": 40.0},
            "optional_member": {"dimension": "validity", "severity": "info", "condition": "startswith(field_value, 'M')", "field_names": ["member_id"], "null_is_pass": True},
            "broken": {"dimension": "accuracy", "severity": "info", "condition": "no_such_column > field_value", "field_names": ["claim_status"]},
            "off": {"dimension": "accuracy", "severity": "info", "condition": "true", "field_names": ["*"], "enabled": False},
        }
    )
    return A.rule_results(assessed(spark, d), rs).select("field", "rule", "passed_count", "passed")


# -- top values ------------------------------------------------------------

@query("tk01_top_values", """
SELECT field, value, n, position FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value ASC NULLS FIRST)::int AS position FROM (
  SELECT 'member_id' AS field, member_id AS value, count(*) AS n FROM claims_feed GROUP BY 2 UNION ALL SELECT 'diagnosis_code', diagnosis_code, count(*) FROM claims_feed GROUP BY 2
  UNION ALL SELECT 'claim_id', claim_id, count(*) FROM claims_feed GROUP BY 2)) WHERE position <= 10""")
def tk01(spark, d):
    return P.top_values(P.value_counts(S.claims_feed(spark, d), ["member_id", "diagnosis_code", "claim_id"]))


@query("so01_distinct_values", "SELECT DISTINCT claim_status, claim_type, place_of_service FROM claims_feed")
def so01(spark, d):
    return S.claims_feed(spark, d).select("claim_status", "claim_type", "place_of_service").distinct()


# -- remediation -----------------------------------------------------------

_FIXED_PHONE = """(SELECT *, CASE WHEN length(p) = 10 THEN p ELSE phone END AS fixed_phone FROM (SELECT *, CASE WHEN length(g) = 11 AND g LIKE '1%' THEN substr(g, 2) ELSE g END AS p
  FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS g FROM members)))"""


@query("rm01_phone", f"SELECT member_id, fixed_phone AS phone FROM {_FIXED_PHONE}")
def rm01(spark, d):
    df = S.members(spark, d)
    return df.withColumns(R.phones(df)).select("member_id", "phone")


@query("rm02_incomplete", """
SELECT (member_id IS NULL OR date_of_service IS NULL OR admission_date IS NULL)::int AS _quality_incomplete, count(*) AS n FROM claims GROUP BY 1""")
def rm02(spark, d):
    flag = R.incomplete(["member_id", "date_of_service", "admission_date", "claim_id"])
    return S.claims(spark, d).groupBy(flag.alias("_quality_incomplete")).agg(F.count("*").alias("n"))


@query("rm03_gender", """
SELECT gender, CASE WHEN upper(gender) IN ('MALE', 'M') THEN 'M' WHEN upper(gender) IN ('FEMALE', 'F') THEN 'F' ELSE gender END AS fixed, count(*) AS n FROM members GROUP BY 1, 2""")
def rm03(spark, d):
    return S.members(spark, d).groupBy("gender", R.gender().alias("fixed")).agg(F.count("*").alias("n"))


@query("rm04_date_format", """
SELECT claim_id, CASE WHEN regexp_matches(date_text, '^\\d{2}/\\d{2}/\\d{4}$') THEN strftime(strptime(date_text, '%m/%d/%Y'), '%Y-%m-%d') ELSE date_text END AS date_text FROM claims""")
def rm04(spark, d):
    return S.claims(spark, d).select("claim_id", R.us_date("date_text").alias("date_text"))


@query("rm05_remediation_log", f"""
SELECT 'phone' AS target, 'corrected' AS action, count(*) FILTER (WHERE fixed_phone <> phone) AS rows_changed FROM {_FIXED_PHONE}
UNION ALL SELECT 'gender', 'corrected', count(*) FILTER (WHERE gender IN ('male', 'Female')) FROM members
UNION ALL SELECT '_quality_incomplete', 'flagged', count(*) FILTER (WHERE email IS NULL) FROM members""")
def rm05(spark, d):
    return R.remediation_log(S.members(spark, d), RuleSet.builtin(AS_OF), ["member_id", "email"])


@query("rm05_remediate", f"""
SELECT member_id, fixed_phone AS phone, CASE WHEN upper(gender) IN ('MALE', 'M') THEN 'M' WHEN upper(gender) IN ('FEMALE', 'F') THEN 'F' ELSE gender END AS gender FROM {_FIXED_PHONE}""")
def rm05_apply(spark, d):
    return R.remediate(S.members(spark, d), RuleSet.builtin(AS_OF), ["member_id", "email"]).select("member_id", "phone", "gender")


@query("ud02_placeholder_rules", """
SELECT field, count(*) FILTER (WHERE ok) AS passed_count, count(*) AS total_count FROM (
  SELECT 'o_orderstatus' AS field, o_orderstatus = 'field_value' OR length(o_orderstatus) = 1 AS ok FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority = 'field_value' OR length(o_orderpriority) = 1 FROM orders) GROUP BY 1""")
def ud02(spark, d):
    """The placeholder is replaced as a token only; text in quotes keeps it."""
    rs = RuleSet().register(Rule("one_letter", "validity", "info", "field_value = 'field_value' OR length(field_value) = 1", ("o_order*",), strings_only=True))
    return A.rule_results(S.table(spark, d, "orders"), rs).select("field", "passed_count", "total_count")


@query("ud04_metric_definitions", """
SELECT round(sum(o_totalprice::decimal(18,2))::double / count(*), 6) AS mean_price, round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::double, 6) AS closed_share, round(count(DISTINCT o_custkey)::double, 6) AS customers FROM orders""")
def ud04(spark, d):
    from dqflow.operators.marts import custom_metrics

    return custom_metrics(
        S.table(spark, d, "orders"),
        {
            "mean_price": "cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*)",
            "closed_share": "count_if(o_orderstatus = 'F') / count(*)",
            "customers": "count(DISTINCT o_custkey)",
        },
    )


@query("tk02_text_patterns", _pattern_sql("conversations", "text") + " UNION ALL " + _pattern_sql("conversations", "role"))
def tk02(spark, d):
    """Pattern counts over every value instead of a sample of rows."""
    return P.patterns(S.table(spark, d, "conversations"), ["text", "role"]).withColumn("avg_length", F.round("avg_length", 6))
