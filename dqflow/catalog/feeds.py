"""Registered queries: keyed state over streams, inferred and evolving feeds, nested documents (ST10, SRC01, SRC02, DR03)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog.base import add_view, query
from dqflow.catalog.storage import HALF, finish
from dqflow.operators.alerts import check_rules
from dqflow.session import work_dir
from dqflow.sources import registry
from dqflow.streaming import inferred, ingest, stateful


def half_ts():
    return F.lit(HALF).cast("timestamp_ntz")


def in_deliveries(spark, rows, ts: str, n: int, name: str) -> str:
    """``rows`` as files that arrive one after another, cut by time."""
    path = work_dir(spark, name)
    rows = rows.withColumn("_day", F.dayofmonth(ts))
    for i in range(n):
        part = rows.where((F.col("_day") * n >= 31 * i) & (F.col("_day") * n < 31 * (i + 1)))
        part.drop("_day").coalesce(1).write.mode("append").parquet(path)
    rows.where(F.col("_day") * n >= 31 * n).drop("_day").coalesce(1).write.mode("append").parquet(path)
    return path


def stream_through(spark, path: str, build, max_files: int = 1):
    """The rows a file feed gives after ``build``, read file by file until nothing is left."""
    target = work_dir(spark, "stream-out")
    stream = ingest.file_stream(spark, path, spark.read.parquet(path).schema, "parquet", max_files=max_files)
    finish(ingest.append_to(build(stream), target, work_dir(spark, "cp")))
    return spark.read.parquet(target)


add_view("metric_alerts", """
SELECT * FROM rule_alerts WHERE rule IN ('high_usage_warning', 'usage_limit_critical', 'pipeline_failure_rate', 'api_response_time')""")


def suppressed(spark, d, deliveries: int = 5):
    path = in_deliveries(spark, S.metrics(spark, d), "timestamp", deliveries, "metrics")
    return stream_through(spark, path, lambda s: stateful.suppress_stream(check_rules(s), ["rule", "tenant_id"], "timestamp", "event_id", "2 hours"))


@query("st10_suppression_rule", """
SELECT event_id, rule, tenant_id, coalesce(timestamp - prev <= INTERVAL 60 MINUTE, false) AS suppressed, hour(timestamp) >= 22 OR hour(timestamp) < 6 AS quiet_hours
FROM (SELECT *, lag(timestamp) OVER (PARTITION BY rule, tenant_id ORDER BY timestamp, event_id) AS prev FROM metric_alerts)
WHERE epoch_ms(timestamp) < (SELECT max(epoch_ms(timestamp)) FROM metric_alerts) - 7200000""")
def st10_rule(spark, d):
    """The 60-minute rule over a feed of deliveries; alerts the watermark has not passed are still open."""
    return suppressed(spark, d).drop("timestamp")


def transitions(spark, d, deliveries: int = 5):
    path = in_deliveries(spark, S.alert_events(spark, d), "timestamp", deliveries, "alert-events")
    return stream_through(spark, path, lambda s: stateful.lifecycle_stream(s, "2 hours"))


@query("st10_lifecycle", """
SELECT alert_id, CASE WHEN epoch_ms(resolved_at) < cut THEN 'resolved' WHEN epoch_ms(acknowledged_at) < cut THEN 'acknowledged' ELSE 'triggered' END AS status,
  strftime(triggered_at, '%Y-%m-%d %H:%M:%S') AS triggered_at, strftime(CASE WHEN epoch_ms(resolved_at) < cut THEN resolved_at END, '%Y-%m-%d %H:%M:%S') AS resolved_at
FROM alert_state, (SELECT max(epoch_ms(timestamp)) - 7200000 AS cut FROM alert_events) WHERE epoch_ms(triggered_at) < cut""")
def st10_lifecycle(spark, d):
    out = stateful.latest_transition(transitions(spark, d))
    return out.select("alert_id", "status", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("triggered_at", "resolved_at")])


# -- inferred feeds --------------------------------------------------------

def json_feed(spark, d):
    """First half as documents of one layout; then a text where a number was, a new field and broken documents."""
    ev = S.events(spark, d)
    first = F.to_json(F.struct("event_id", "event_type", "user_id", "value"))
    user = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("u"), "user_id")).otherwise(F.col("user_id").cast("string"))
    later = F.to_json(F.struct("event_id", "event_type", user.alias("user_id"), "value", F.lit("web").alias("channel")))
    later = F.when(F.col("event_id") % 50 == 0, F.substring(later, 1, 20)).otherwise(later)
    return ev.where(F.col("ts") < half_ts()).select(first.alias("value")), ev.where(F.col("ts") >= half_ts()).select(later.alias("value"))


@query("src01_inferred_json", f"""
WITH x AS (SELECT *, ts >= TIMESTAMP '{HALF}' AS later, ts >= TIMESTAMP '{HALF}' AND event_id % 50 = 0 AS broken, ts >= TIMESTAMP '{HALF}' AND event_id % 7 = 0 AS odd FROM events)
SELECT count(*) AS n, count(*) FILTER (WHERE NOT broken) AS typed, count(DISTINCT user_id) FILTER (WHERE NOT broken AND NOT odd) AS users,
  count(*) FILTER (WHERE later) AS rescued, count(*) FILTER (WHERE later AND NOT broken) AS channels, count(*) FILTER (WHERE broken) AS broken,
  sum(user_id) FILTER (WHERE odd AND NOT broken)::bigint AS rescued_users, sum(value::decimal(18,2)) FILTER (WHERE NOT broken)::double AS total FROM x""")
def src01_json(spark, d):
    """The schema is inferred from the first delivery and stored; the restart meets what it does not know."""
    path, target = work_dir(spark, "feed"), work_dir(spark, "inferred")
    cp, location = work_dir(spark, "cp"), work_dir(spark, "schema")
    for part in json_feed(spark, d):
        part.write.mode("append").text(path)
        finish(ingest.append_to(inferred.inferred_stream(spark, path, location, "json"), target, cp))
    out = spark.read.parquet(target)
    saved = lambda name: F.get_json_object(inferred.RESCUED, f"$.{name}")
    return out.agg(
        F.count("*").alias("n"), F.count("event_id").alias("typed"), F.countDistinct("user_id").alias("users"), F.count(inferred.RESCUED).alias("rescued"),
        F.count(saved("channel")).alias("channels"), F.count(saved(inferred.CORRUPT)).alias("broken"),
        F.sum(F.substring(saved("user_id"), 2, 20).cast("bigint")).alias("rescued_users"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("src01_inferred_csv", f"""
WITH x AS (SELECT *, ts >= TIMESTAMP '{HALF}' AS later, ts >= TIMESTAMP '{HALF}' AND event_id % 9 = 0 AS odd FROM events)
SELECT event_type, count(*) AS n, sum(value::decimal(18,2)) FILTER (WHERE NOT odd)::double AS total, count(*) FILTER (WHERE odd) AS misfits, count(*) FILTER (WHERE later) AS lines FROM x GROUP BY 1""")
def src01_csv(spark, d):
    """A later delivery writes a word for missing numbers and one more column: values and lines are kept as text."""
    ev, path, target = S.events(spark, d), work_dir(spark, "feed"), work_dir(spark, "inferred")
    cp, location = work_dir(spark, "cp"), work_dir(spark, "schema")
    columns = ["event_id", "event_type", "user_id", F.col("value").cast("string").alias("value")]
    later = ev.where(F.col("ts") >= half_ts()).withColumn("value", F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string")))
    for part in (ev.where(F.col("ts") < half_ts()).select(*columns), later.select(*columns, F.lit("web").alias("channel"))):
        part.write.mode("append").option("header", True).csv(path)
        finish(ingest.append_to(inferred.inferred_stream(spark, path, location, "csv"), target, cp))
    kept = spark.read.parquet(target)
    return kept.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        F.count_if(F.get_json_object(inferred.RESCUED, "$.value") == "n/a").alias("misfits"), F.count(F.get_json_object(inferred.RESCUED, f"$.{inferred.CORRUPT}")).alias("lines"))


@query("src02_registry_evolution", """
WITH x AS (SELECT *, day(ts) AS day FROM events)
SELECT 'target' AS what, count(*) AS n, sum(CASE WHEN day < 17 THEN floor(value) ELSE value END::decimal(18,2))::double AS total, count(*) FILTER (WHERE day >= 9) AS channels FROM x WHERE day < 25
UNION ALL SELECT 'quarantine', count(*), NULL, count(*) FROM x WHERE day >= 25
UNION ALL SELECT 'version ' || v, f, NULL, a FROM (SELECT 1 AS v, 3 AS f, 0 AS a UNION ALL SELECT 2, 4, 1 UNION ALL SELECT 3, 4, 1), (SELECT count(*) FROM events)""")
def src02_evolution(spark, d):
    """Four deliveries: the base layout, a new field, a wider number, and an id that becomes text (quarantined)."""
    ev = S.events(spark, d).withColumn("day", F.dayofmonth("ts"))
    path, target, cp, versions = (work_dir(spark, n) for n in ("feed", "evolved", "cp", "registry"))
    whole, web = F.floor("value").alias("amount"), F.lit("web").alias("channel")
    layouts = [
        F.struct("event_id", "event_type", whole), F.struct("event_id", "event_type", whole, web),
        F.struct("event_id", "event_type", F.col("value").alias("amount"), web),
        F.struct(F.concat(F.lit("e"), "event_id").alias("event_id"), "event_type", F.col("value").alias("amount"), web),
    ]
    for i, layout in enumerate(layouts):
        first, last = 8 * i + 1, 8 * i + 9 if i < 3 else 32
        ev.where((F.col("day") >= first) & (F.col("day") < last)).select(F.to_json(layout).alias("value")).write.mode("append").text(path)
        inferred.evolving_ingest(spark, "events", path, target, cp, versions, S.EVENTS_AS_OF)
    reg = inferred.read_registry(spark, versions)
    schema = registry.active_schema(reg, "events")
    kept, bad = inferred.read_evolved(spark, target, schema), spark.read.parquet(f"{target}_quarantine")
    fields = F.from_json("schema_json", "struct<fields:array<struct<name:string>>>")["fields"]
    return registry.union_all([
        kept.agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.count("channel").alias("channels")).withColumn("what", F.lit("target")),
        bad.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("total"), F.count(F.get_json_object("value", "$.channel")).alias("channels")).withColumn("what", F.lit("quarantine")),
        reg.select(F.concat(F.lit("version "), "version").alias("what"), F.size(fields).cast("bigint").alias("n"), F.lit(None).cast("double").alias("total"),
                   F.size(F.filter(fields, lambda f: f["name"] == "channel")).cast("bigint").alias("channels")),
    ]).select("what", "n", "total", "channels")


# -- nested documents ------------------------------------------------------

def nested_documents(spark, d):
    """Documents with objects, arrays and a map, whose inner fields change halfway."""
    old = F.to_json(F.struct("event_id", F.struct("user_id", F.array(F.col("event_id") % 3, F.col("event_id") % 5).alias("marks")).alias("who"),
                             F.create_map(F.concat(F.lit("k"), F.col("event_id") % 4), F.col("event_id")).alias("extra")))
    geo = F.struct(F.when(F.col("event_id") % 6 != 0, "event_type").alias("place"))
    items = F.array(F.struct(F.col("value").alias("price")), F.struct(F.col("value").alias("price")))
    new = F.to_json(F.struct("event_id", F.struct(F.concat(F.lit("u"), "user_id").alias("user_id"), F.array(F.col("value")).alias("marks"), geo.alias("geo")).alias("who"), items.alias("items"),
                             F.create_map(F.concat(F.lit("k"), F.col("event_id") % 4), F.col("event_type")).alias("extra")))
    late = F.col("ts") >= half_ts()
    return S.events(spark, d).select(F.when(late, new).otherwise(old).alias("doc"), F.when(late, "new").otherwise("old").alias("era"))


@query("dr03_nested_diff", f"""
WITH docs AS (
  SELECT CASE WHEN ts >= TIMESTAMP '{HALF}' THEN 'new' ELSE 'old' END AS era,
    CASE WHEN ts >= TIMESTAMP '{HALF}' THEN json_object('event_id', event_id, 'who', json_object('user_id', 'u' || user_id, 'marks', json_array(value), 'geo', CASE WHEN event_id % 6 <> 0 THEN json_object('place', event_type) ELSE json_object() END),
        'items', json_array(json_object('price', value), json_object('price', value)), 'extra', json_object('k' || (event_id % 4), event_type))
    ELSE json_object('event_id', event_id, 'who', json_object('user_id', user_id, 'marks', json_array(event_id % 3, event_id % 5)), 'extra', json_object('k' || (event_id % 4), event_id)) END AS doc FROM events),
nodes AS (SELECT era, regexp_replace(regexp_replace(regexp_replace(substr(fullkey, 3), '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g'), '^extra\\..*$', 'extra{{}}') AS path, type FROM docs, json_tree(doc) WHERE fullkey <> '$'),
kinds AS (SELECT era, path, CASE WHEN type IN ('BIGINT', 'UBIGINT') THEN 'bigint' WHEN type = 'DOUBLE' THEN 'double' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'OBJECT' THEN 'struct' WHEN type = 'ARRAY' THEN 'array' ELSE type END AS kind, count(*) AS n FROM nodes GROUP BY 1, 2, 3),
fields AS (SELECT era, path, any_value(kind) AS kind, sum(n) AS n FROM kinds GROUP BY 1, 2),
seen AS (SELECT f.era, f.path, f.kind, NOT ends_with(f.path, '[]') AND NOT ends_with(f.path, '{{}}') AND f.n < coalesce(p.n, (SELECT count(*) FROM docs WHERE docs.era = f.era)) AS nullable
  FROM fields f LEFT JOIN fields p ON p.era = f.era AND p.path = regexp_replace(f.path, '\\.[^.]*$', '') AND contains(f.path, '.'))
SELECT path, CASE WHEN o.path IS NULL THEN 'field_added' WHEN n.path IS NULL THEN 'field_removed' WHEN o.kind <> n.kind THEN 'data_type_changed' ELSE 'nullability_changed' END AS change, o.kind AS old_type, n.kind AS new_type, n.nullable AS new_null
FROM (SELECT * FROM seen WHERE era = 'old') o FULL JOIN (SELECT * FROM seen WHERE era = 'new') n USING (path)
WHERE o.path IS NULL OR n.path IS NULL OR o.kind <> n.kind OR o.nullable <> n.nullable""")
def dr03_nested(spark, d):
    fields = registry.observed_fields(nested_documents(spark, d), "doc", ["era"], maps=["extra"])
    sides = [fields.where(F.col("era") == e).drop("era") for e in ("old", "new")]
    return registry.diff(*sides).select("path", "change", "old_type", "new_type", "new_null")
