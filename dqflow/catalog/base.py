"""Query registry and the DuckDB side of the table shapes."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from dqflow.shapes import ERROR_TEXTS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, when SQL can express it, its oracle."""

    def register(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


_ERRORS = ", ".join(f"'{t}'" for t in ERROR_TEXTS)

# The shapes of dqflow.shapes once more, as SQL over the raw tables.
VIEWS = {
    "claims": """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS claim_id,
  CASE WHEN k % 37 <> 0 THEN 'M' || lpad(o_custkey::varchar, 9, '0') END AS member_id,
  (1000000000 + l_suppkey)::varchar AS provider_npi,
  CASE WHEN k % 41 = 0 THEN '#' ELSE '' END || chr((65 + l_suppkey % 26)::int) || lpad(l_linenumber::varchar, 2, '0') AS diagnosis_code,
  lpad(l_partkey::varchar, 5, '0') AS procedure_code,
  CASE WHEN k % 53 = 0 THEN 'invalid-date' WHEN k % 3 = 0 THEN strftime(l_shipdate, '%m/%d/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_text,
  CASE WHEN k % 53 <> 0 THEN l_shipdate::date END AS date_of_service,
  CASE WHEN k % 43 = 0 THEN 0 WHEN k % 47 = 0 THEN -amount WHEN k % 97 = 0 THEN amount * 20 ELSE amount END::decimal(18,2) AS claim_amount,
  CASE WHEN k % 59 = 0 THEN '00' ELSE (l_linenumber + 19)::varchar END AS place_of_service,
  CASE l_returnflag WHEN 'R' THEN 'DENIED' WHEN 'A' THEN 'PAID' ELSE 'PROCESSING' END AS claim_status,
  CASE WHEN l_linestatus = 'O' THEN 'PHARMACY' ELSE 'MEDICAL' END AS claim_type,
  l_shipdate::date + (l_quantity * 3)::int AS submission_date,
  CASE WHEN k % 5 <> 0 THEN l_shipdate::date - l_linenumber END AS admission_date,
  l_shipdate::date + (k % 500 - 10)::int AS discharge_date,
  o_orderdate::date AS created_date, k
FROM (SELECT *, l_orderkey * 7 + l_partkey AS k, l_extendedprice::decimal(18,2) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "claims_feed": """
SELECT * FROM claims UNION ALL
SELECT * REPLACE (claim_id || '-R' AS claim_id, created_date + 1 AS created_date, submission_date + (k % 60)::int AS submission_date)
FROM claims WHERE k % 29 = 0""",
    "raw_claims": """
SELECT *, CASE WHEN k % 61 <> 0 THEN claim_id END AS record_id, TIMESTAMP '2001-12-01' - to_hours((k % 60)::int) AS _ingestion_timestamp FROM claims_feed""",
    "order_span": "SELECT o_custkey, min(o_orderdate)::date AS lo, max(o_orderdate)::date AS hi FROM orders GROUP BY o_custkey",
    "eligibility": """
SELECT 'M' || lpad(o_custkey::varchar, 9, '0') AS member_id, lo AS start_date, (lo + ((hi - lo) // 2)::int)::date AS end_date, 'ACTIVE' AS status FROM order_span
UNION ALL
SELECT 'M' || lpad(o_custkey::varchar, 9, '0'), (lo + ((hi - lo) // 2)::int + (o_custkey % 200)::int)::date,
  CASE WHEN o_custkey % 5 <> 0 THEN hi END, CASE WHEN o_custkey % 7 = 0 THEN 'TERMED' ELSE 'ACTIVE' END FROM order_span""",
    "members": """
SELECT 'M' || lpad(c_custkey::varchar, 9, '0') AS member_id, c_name AS last_name,
  (DATE '1915-01-01' + (c_custkey * 37 % 32000)::int)::date AS date_of_birth,
  ['M', 'F', 'U', 'male', 'Female', 'Q'][(c_custkey % 6 + 1)::int] AS gender,
  CASE c_custkey % 4 WHEN 0 THEN '+1555' || digits WHEN 1 THEN '(555) ' || substr(digits, 1, 3) || '-' || substr(digits, 4, 4)
    WHEN 2 THEN '555' || digits ELSE '123' END AS phone,
  CASE WHEN c_custkey % 9 = 0 THEN c_name WHEN c_custkey % 11 <> 0 THEN 'user' || c_custkey || '@example.com' END AS email,
  lpad((c_custkey % 900)::varchar, 3, '0') || '-' || lpad((c_custkey % 97)::varchar, 2, '0') || '-' || lpad((c_custkey * 31 % 10000)::varchar, 4, '0') AS ssn,
  CASE WHEN c_custkey % 13 = 0 THEN 'ABC' ELSE lpad((c_custkey * 17 % 100000)::varchar, 5, '0') END AS zip_code,
  ['CA', 'NY', 'TX'][c_nationkey % 3 + 1] AS state, c_mktsegment AS plan_type,
  lo AS eligibility_start, CASE WHEN c_custkey % 5 <> 0 THEN hi END AS eligibility_end, c_custkey AS custkey
FROM (SELECT *, lpad((c_custkey * 7919 % 10000000)::varchar, 7, '0') AS digits FROM customer)
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN order_span ON o_custkey = c_custkey""",
    "providers": """
SELECT (1000000000 + s_suppkey)::varchar AS provider_npi, s_name AS provider_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Organization' ELSE 'Individual' END AS provider_type,
  CASE WHEN s_suppkey % 8 = 0 THEN '207Q' WHEN s_suppkey % 10 <> 0 THEN '207Q' || lpad((s_suppkey % 100000)::varchar, 5, '0') || 'X' END AS taxonomy_code,
  'LIC' || s_suppkey AS license_number, CASE WHEN s_suppkey % 6 = 0 THEN 'Cal' ELSE 'CA' END AS license_state,
  CASE WHEN s_suppkey % 4 <> 0 THEN (DATE '2000-01-01' + (s_suppkey * 13 % 1500)::int)::date END AS license_expiration_date,
  CASE WHEN s_suppkey % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
  CASE WHEN s_suppkey % 7 = 0 THEN (DATE '1998-01-01' + (s_suppkey * 29 % 1200)::int)::date END AS termination_date,
  n_name AS provider_specialty, ['CA', 'NY', 'TX'][s_nationkey % 3 + 1] AS provider_state, s_suppkey AS suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "network": """
SELECT (1000000000 + s_suppkey)::varchar AS provider_npi,
  CASE WHEN s_suppkey % 9 = 0 THEN 'SUSPENDED' ELSE 'PARTICIPATING' END AS network_status,
  (st + o)::date AS contract_start_date,
  CASE WHEN o = 1700 AND s_suppkey % 3 = 0 THEN NULL ELSE (st + o + len)::date END AS contract_end_date
FROM (SELECT s_suppkey, (DATE '1995-06-01' + (s_suppkey * 11 % 700)::int)::date AS st FROM supplier),
  (VALUES (0, 900), (600, 800), (1700, 300)) AS v(o, len)""",
    "high_cost_procedures": "SELECT lpad(p_partkey::varchar, 5, '0') AS code FROM part WHERE p_size >= 40",
    "prior_auths": """
SELECT member_id, procedure_code, submission_date - 90 AS auth_start_date, submission_date + 10 AS auth_end_date,
  CASE WHEN k % 2 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status
FROM claims WHERE k % 9 = 0 AND member_id IS NOT NULL""",
    "diagnosis_reference": """
SELECT DISTINCT code AS diagnosis_code, 'Condition ' || code AS diagnosis_description, substr(code, 1, 1) AS category
FROM (SELECT chr((65 + l_suppkey % 26)::int) || lpad(l_linenumber::varchar, 2, '0') AS code FROM lineitem) WHERE code < 'N'""",
    "ev": """SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '"k": ([0-9]+)', 1)::int AS k FROM events""",
    "runs": f"""
SELECT 'run-' || event_id AS run_id, 'p' || (user_id % 25) AS pipeline_id, 't' || (user_id % 10) AS tenant_id, ts AS started_at,
  value::decimal(18,2) AS execution_time_seconds, (value::decimal(18,6) / 10)::decimal(18,6) AS gb_processed,
  CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view' AND k % 10 = 0 THEN 'CANCELLED' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_type = 'error' THEN [{_ERRORS}][k % {len(ERROR_TEXTS)} + 1] END AS error_message,
  k % 4 AS retry_count, k % 3 = 0 AS resolved, k, event_id FROM ev""",
    "usage_events": """
SELECT 't' || (user_id % 10) AS tenant_id,
  CASE event_type WHEN 'click' THEN 'quality_checks' WHEN 'view' THEN 'gb_processed' WHEN 'purchase' THEN 'compute_hours' ELSE 'storage_gb' END AS event_type,
  value::decimal(18,6) AS quantity, ts AS timestamp, 'p' || (user_id % 25) AS pipeline_id, event_id
FROM ev WHERE event_type IN ('click', 'view', 'purchase', 'signup')""",
    "metrics": """
SELECT event_id, CASE event_type WHEN 'click' THEN 'tenant_usage_percentage' WHEN 'view' THEN 'api_response_time'
    WHEN 'purchase' THEN 'pipeline_failure_rate' WHEN 'signup' THEN 'quality_score' WHEN 'error' THEN 'success_rate' END AS metric_name,
  (value::decimal(18,2) * CASE WHEN event_type = 'view' THEN 40 ELSE 1 END)::decimal(18,2) AS value, ts AS timestamp,
  't' || (user_id % 10) AS tenant_id, 'c' || (user_id % 6) AS component FROM ev""",
    "health_checks": """
SELECT event_id, 'c' || (user_id % 6) AS component, ts AS timestamp, value::decimal(18,2) * 40 AS response_time, event_type = 'error' AS error FROM ev""",
    "alert_events": """
SELECT 'a-' || user_id || '-' || strftime(ts, '%m%d') AS alert_id, 't' || (user_id % 10) AS tenant_id,
  ['critical', 'error', 'warning', 'info'][(user_id % 4 + 1)::int] AS severity, 'c' || (user_id % 6) AS component,
  CASE event_type WHEN 'click' THEN 'acknowledge' WHEN 'purchase' THEN 'resolve' ELSE 'trigger' END AS action, ts AS timestamp, event_id FROM ev""",
    "audit_logs": """
SELECT user_id, ['SELECT', 'EXPORT', 'DOWNLOAD', 'COPY', 'CREATE', 'DROP', 'ALTER', 'GRANT', 'REVOKE', 'LOGIN_FAILED'][k % 10 + 1] AS action_name,
  CASE WHEN event_type = 'view' THEN 'claims' ELSE 'members' END AS table_name,
  ['claim_id,claim_amount', 'member_id,phone', 'ssn', 'email,state', 'address', 'provider_npi'][(event_id % 6 + 1)::int] AS accessed_columns,
  ts AS access_time, value::decimal(18,2) * 100 AS rows_affected, event_id FROM ev""",
    "accounts": """
SELECT tenant_id, ['starter', 'professional', 'enterprise', 'healthcare_plus'][idx % 4 + 1] AS plan_id,
  CASE WHEN idx % 3 = 0 THEN 'annual' ELSE 'monthly' END AS billing_period, DATE '2024-01-01' AS current_period_start,
  CASE WHEN idx % 3 = 0 THEN DATE '2024-12-31' ELSE DATE '2024-01-31' END AS current_period_end
FROM (SELECT DISTINCT tenant_id, substr(tenant_id, 2)::int AS idx FROM usage_events)""",
}


def add_view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the statement with the views it uses, dependencies first."""
    needed: list[str] = []

    def visit(text: str, seen: tuple):
        for name in VIEWS:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                if name not in needed:
                    visit(VIEWS[name], (*seen, name))
                    if name not in needed:
                        needed.append(name)

    visit(sql, ())
    if not needed:
        return sql.strip()
    body = sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
