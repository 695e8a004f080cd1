"""Registered queries: sources, sinks, schema registry and streams (SRC, SNK, DR, ST, PL10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from dqflow import shapes as S
from dqflow.catalog.base import query
from dqflow.operators import expect as E
from dqflow.session import work_dir
from dqflow.sources import files, merge, registry, tables
from dqflow.streaming import ingest, windows

HALF = dt.date(2024, 1, 16)
BY_TYPE = "SELECT event_type, count(*) AS n, sum(value::decimal(18,2))::double AS total FROM events GROUP BY 1"


def by_type(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def split_files(spark, d, n=4):
    """The event table as several files, the way a feed arrives."""
    path = work_dir(spark, "feed")
    S.events(spark, d).repartition(n, "event_id").write.parquet(path)
    return path


# -- batch sources ---------------------------------------------------------

@query("src03_batch_formats", """
SELECT format, event_type, n, total FROM (SELECT event_type, count(*) AS n, sum(value::decimal(18,2))::double AS total FROM events GROUP BY 1), (VALUES ('json'), ('csv'), ('parquet')) f(format)""")
def src03(spark, d):
    """Write the events in each format and read them back under a given schema."""
    ev = S.events(spark, d).select("event_id", "event_type", "value", "props")
    out = []
    for fmt in files.FORMATS:
        path = work_dir(spark, f"src-{fmt}")
        files.export(ev, path, fmt)
        back = files.read_batch(spark, path, fmt, "event_id bigint, event_type string, value double, props string")
        out.append(by_type(back).select(F.lit(fmt).alias("format"), "event_type", "n", "total"))
    return registry.union_all(out)


@query("src04_lineage", "SELECT 'events.parquet' AS source, 'feed-1' AS source_id, count(*) AS n FROM events")
def src04(spark, d):
    df = files.with_lineage(files.read_batch(spark, f"{d}/events.parquet", "parquet"), "feed-1", S.EVENTS_AS_OF)
    return df.groupBy(F.element_at(F.split("_source_file", "/"), -1).alias("source"), F.col("_pipeline_id").alias("source_id")).agg(F.count("*").alias("n"))


@query("src05_latest_metrics", """
SELECT pipeline_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC) AS r FROM runs) WHERE r = 1""")
def src05(spark, d):
    return merge.latest_by(S.runs(spark, d), "pipeline_id", "started_at").select("pipeline_id", "event_id", "status")


@query("src06_configured_feeds", """
SELECT name, count(*) AS n, avg(q10) / 10 < min_quality AS low_quality FROM scored, (VALUES ('medicaid', 0.99::double), ('medicare', 0.85), ('providers', 0.5)) s(name, min_quality) GROUP BY name, min_quality""")
def src06(spark, d):
    """The same table assessed under the limits of three configured feeds."""
    from dqflow.catalog.quality import scored
    from dqflow.operators import marts as M

    specs = files.load_specs({n: {"source_path": d, "target_table": n, "min_quality": q} for n, q in (("medicaid", 0.99), ("medicare", 0.85), ("providers", 0.5))})
    m = M.table_metrics(scored(spark, d))
    return registry.union_all(
        [m.select(F.lit(s.name).alias("name"), F.col("total_records").alias("n"), (F.col("avg_quality_score") < s.min_quality).alias("low_quality")) for s in specs]
    )


@query("src07_state_feeds", "SELECT CASE WHEN event_id % 2 = 0 THEN 'CA' ELSE 'NY' END AS state, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN props END) AS with_props FROM events GROUP BY 1")
def src07(spark, d):
    ev = S.events(spark, d)
    paths = {"CA": work_dir(spark, "state-ca"), "NY": work_dir(spark, "state-ny")}
    ev.where("event_id % 2 = 0").write.parquet(paths["CA"])
    ev.where("event_id % 2 = 1").drop("props").write.parquet(paths["NY"])
    return files.read_states(spark, paths, "parquet").groupBy("state").agg(F.count("*").alias("n"), F.count("props").alias("with_props"))


# -- sinks -----------------------------------------------------------------

_UPSERT = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 0
UNION ALL SELECT o_orderkey, o_custkey, 'U', o_totalprice + 2 FROM orders WHERE o_orderkey % 10 = 0"""


def upsert_input(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    target = o.where("o_orderkey % 4 != 0")
    changed = o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("U"))
    source = changed.withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("seq", F.lit(1)).unionByName(
        changed.withColumn("o_totalprice", F.col("o_totalprice") + 2).withColumn("seq", F.lit(2))
    )
    return target, source


@query("snk01_upsert", _UPSERT)
def snk01(spark, d):
    target, source = upsert_input(spark, d)
    return merge.upsert(target, source, "o_orderkey", ["seq"]).drop("seq")


@query("snk01_merge_table", _UPSERT)
def snk01_table(spark, d):
    """Create, merge and merge again: the second merge changes nothing."""
    target, source = upsert_input(spark, d)
    path = work_dir(spark, "orders")
    merge.merge_into(path, target.withColumn("seq", F.lit(0)), "o_orderkey", ["seq"], "000001")
    merge.merge_into(path, source, "o_orderkey", ["seq"], "000002")
    return merge.merge_into(path, source, "o_orderkey", ["seq"], "000003").drop("seq")


@query("snk01_upsert_maps", """
SELECT event_id, tenant_id, quantity, CASE WHEN event_id % 10 = 0 THEN 'corrected' ELSE event_id::varchar END AS source_event FROM usage_events""")
def snk01_maps(spark, d):
    """Usage events, whose metadata is a map, with every tenth delivered again."""
    target = S.usage_events(spark, d)
    again = target.where("event_id % 10 = 0").withColumn("metadata", F.create_map(F.lit("source_event"), F.lit("corrected"))).withColumn("seq", F.lit(1))
    return merge.upsert(target, again, "event_id", ["seq"]).select("event_id", "tenant_id", "quantity", F.col("metadata")["source_event"].alias("source_event"))


@query("snk01_merge_partitions", _UPSERT)
def snk01_partitions(spark, d):
    target, source = upsert_input(spark, d)
    path = work_dir(spark, "orders-by-status")
    merge.create_partitions(target.withColumn("seq", F.lit(0)), path, "0001", "o_orderstatus")
    return merge.merge_partitions(path, source, "o_orderkey", ["seq"], "o_orderstatus", "0002").drop("seq")


@query("snk02_merge_schema", "SELECT event_type, count(*) AS n, count(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN props END) AS with_props FROM events GROUP BY 1")
def snk02(spark, d):
    path, cut = work_dir(spark, "merge-schema"), F.lit(HALF).cast("timestamp_ntz")
    ev = S.events(spark, d)
    ev.where(F.col("ts") < cut).drop("props").write.mode("append").parquet(path)
    ev.where(F.col("ts") >= cut).write.mode("append").parquet(path)
    return files.read_batch(spark, path, "parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"))


@query("snk03_append_log", "SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS n FROM runs WHERE status = 'FAILED' GROUP BY 1")
def snk03(spark, d):
    path = work_dir(spark, "failures-log")
    merge.append_log(S.runs(spark, d).where("status = 'FAILED'"), path, "started_at")
    return spark.read.parquet(path).groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("snk04_operational_tables", "SELECT pipeline_id, count(*) AS total_records, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count FROM runs GROUP BY 1")
def snk04(spark, d):
    """Run metrics shaped to the operational schema, written and read under it."""
    m = S.runs(spark, d).groupBy("pipeline_id").agg(
        F.max("started_at").cast("timestamp").alias("timestamp"), F.count("*").alias("total_records"),
        F.count_if(F.col("status") == "SUCCESS").alias("success_count"), F.count_if(F.col("status") != "SUCCESS").alias("failure_count"),
        F.sum("execution_time_seconds").cast("double").alias("processing_time_seconds"),
        (F.count("*") / F.sum("execution_time_seconds").cast("double")).alias("throughput_records_per_second"),
        F.max("error_message").alias("error_details"),
    )
    path = work_dir(spark, "pipeline-metrics")
    m.write.parquet(path)
    return spark.read.schema(tables.OPERATIONAL["pipeline_metrics"]).parquet(path).select("pipeline_id", "total_records", "success_count")


@query("snk05_snapshot", BY_TYPE)
def snk05(spark, d):
    name = merge.snapshot(S.events(spark, d), work_dir(spark, "events"), S.EVENTS_AS_OF)
    return by_type(spark.read.parquet(name))


@query("snk06_export", "SELECT event_type, count(*) AS n, sum(value::decimal(18,2))::double AS total FROM events GROUP BY 1")
def snk06(spark, d):
    path = work_dir(spark, "export")
    files.export(by_type(S.events(spark, d)), path, "csv")
    return files.read_batch(spark, path, "csv", "event_type string, n bigint, total double")


@query("snk07_compaction", "SELECT claim_status, count(*) AS n, sum(claim_amount)::double AS total FROM claims WHERE date_of_service >= DATE '2000-01-01' GROUP BY 1")
def snk07(spark, d):
    path = work_dir(spark, "claims-clustered")
    merge.compact(S.claims(spark, d), path, ["date_of_service", "provider_npi"], 8, ["claim_status"])
    kept = spark.read.parquet(path).where(F.col("date_of_service") >= F.lit(dt.date(2000, 1, 1)))
    return kept.groupBy("claim_status").agg(F.count("*").alias("n"), F.sum("claim_amount").cast("double").alias("total"))


@query("snk08_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY 1")
def snk08(spark, d):
    return merge.retained(S.events(spark, d), "ts", "metrics", S.EVENTS_AS_OF, days=10).groupBy("event_type").agg(F.count("*").alias("n"))


# -- schemas ---------------------------------------------------------------

def documents(spark, d):
    """Events as JSON documents whose layout changes halfway through the month."""
    old = F.to_json(F.struct("event_id", "event_type", F.col("user_id"), F.col("value")))
    new = F.to_json(
        F.struct("event_id", "event_type", F.concat(F.lit("u"), "user_id").alias("user_id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.lit("web").alias("channel"))
    )
    late = F.col("ts") >= F.lit(HALF).cast("timestamp_ntz")
    return S.events(spark, d).select(
        F.to_date("ts").alias("day"), F.when(late, new).otherwise(old).alias("doc"), F.when(late, F.lit("new")).otherwise(F.lit("old")).alias("era")
    )


def eras(spark, d):
    docs = documents(spark, d)
    return registry.observed_schema(docs.where("era = 'old'"), "doc"), registry.observed_schema(docs.where("era = 'new'"), "doc")


# The documents again, their fields per group, and the comparison of two groups, all from the JSON itself.
_DOCS = f"""
WITH docs AS (
  SELECT ts::date AS day, CASE WHEN ts >= TIMESTAMP '{HALF}' THEN 'new' ELSE 'old' END AS era,
    CASE WHEN ts >= TIMESTAMP '{HALF}' THEN json_object('event_id', event_id, 'event_type', event_type, 'user_id', 'u' || user_id, 'value', CASE WHEN event_id % 7 <> 0 THEN value END, 'channel', 'web')
    ELSE json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id, 'value', value) END AS doc FROM events),
found AS (SELECT day, era, path, json_type(doc, '$.' || path) AS kind FROM (SELECT day, era, doc, unnest(json_keys(doc)) AS path FROM docs)),
typed AS (SELECT day, era, path, CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'whole' ELSE kind END AS kind FROM found WHERE kind <> 'NULL'),
fields AS (SELECT era, path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind, count(*) < any_value(n) AS nullable FROM typed JOIN (SELECT era, count(*) AS n FROM docs GROUP BY 1) USING (era) GROUP BY 1, 2),
pairs AS (
  SELECT a, b, p.path, CASE WHEN l.path IS NULL THEN 'field_added' WHEN r.path IS NULL THEN 'field_removed' WHEN l.kind <> r.kind THEN 'data_type_changed' WHEN l.nullable <> r.nullable THEN 'nullability_changed' END AS change
  FROM (SELECT a, b, path FROM (SELECT 'old' AS a, 'new' AS b UNION ALL SELECT 'new', 'old'), (SELECT DISTINCT path FROM fields)) p
  LEFT JOIN fields l ON l.path = p.path AND l.era = p.a LEFT JOIN fields r ON r.path = p.path AND r.era = p.b)
"""
_JUDGED = """
count(change) AS changes,
  CASE WHEN bool_or(change IN ('field_removed', 'data_type_changed')) THEN 'breaking' WHEN bool_or(change = 'field_added') THEN 'forward' WHEN count(change) > 0 THEN 'backward' ELSE 'full' END AS compatibility,
  CASE WHEN count(DISTINCT change) > 1 OR bool_or(change = 'data_type_changed') THEN 'major_change' WHEN bool_or(change = 'field_added') THEN 'field_addition' WHEN bool_or(change = 'field_removed') THEN 'field_removal' ELSE 'minor_change' END AS change_type
"""
_LAYOUTS = _DOCS + """
, layouts AS (SELECT day, string_agg(path || ':' || kind, ',' ORDER BY path) AS layout FROM (SELECT day, path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind FROM typed GROUP BY 1, 2) GROUP BY 1),
versions AS (SELECT row_number() OVER (ORDER BY first)::int AS version, first, row_number() OVER (ORDER BY first DESC) = 1 AS is_active FROM (SELECT layout, min(day) AS first FROM layouts GROUP BY 1))
"""


@query("dr03_schema_diff", _DOCS + "SELECT path, change FROM pairs WHERE a = 'old' AND change IS NOT NULL")
def dr03(spark, d):
    return registry.diff(*eras(spark, d)).select("path", "change")


@query("dr04_compatibility", _DOCS + f"SELECT {_JUDGED} FROM pairs WHERE a = 'old'")
def dr04(spark, d):
    return registry.judge(registry.diff(*eras(spark, d)))


@query("dr05_change_class", _DOCS + f"""
SELECT change_type, compatibility, part FROM (SELECT part, {_JUDGED} FROM pairs, (VALUES ('channel', 'old', 'channel'), ('channel,user_id', 'new', 'channel'), ('all', 'old', '%'), ('value', 'old', 'value')) v(part, side, shown)
  WHERE a = side AND path LIKE shown GROUP BY part)""")
def dr05(spark, d):
    """The same two eras compared on parts of their fields, and backwards."""
    old, new = eras(spark, d)
    cases = {
        "channel": (old, new, "path = 'channel'"), "channel,user_id": (new, old, "path = 'channel'"),
        "all": (old, new, "true"), "value": (old, new, "path = 'value'"),
    }
    return registry.union_all(
        [registry.judge(registry.diff(a.where(c), b.where(c))).select("change_type", "compatibility", F.lit(n).alias("part")) for n, (a, b, c) in cases.items()]
    )


def versions(spark, d):
    """Registry rows: one version per distinct daily layout of the feed."""
    fields = registry.observed_schema(documents(spark, d), "doc", ["day"])
    layout = fields.groupBy("day").agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "type")))).alias("schema_json"))
    first = layout.groupBy("schema_json").agg(F.min("day").alias("registered_at"))
    number = F.row_number().over(W.orderBy("registered_at"))  # one row per layout
    return first.select(F.lit("events").alias("table_name"), number.alias("version"), "schema_json", "registered_at")


@query("dr01_active_schema", _LAYOUTS + "SELECT 'events' AS table_name, version, strftime(first, '%Y-%m-%d') AS registered_at FROM versions WHERE is_active")
def dr01(spark, d):
    out = registry.with_active(versions(spark, d)).where("is_active")
    return out.select("table_name", "version", F.date_format("registered_at", "yyyy-MM-dd").alias("registered_at"))


@query("dr02_registered_versions", _LAYOUTS + "SELECT version, is_active FROM versions")
def dr02(spark, d):
    return registry.with_active(versions(spark, d)).select("version", "is_active")


@query("dr06_detection", """
SELECT step, status, compatibility, n FROM (VALUES (1, 'initial_registration', 'full'), (2, 'no_change', 'full'), (3, 'field_addition', 'forward'), (4, 'field_removal', 'breaking')) v(step, status, compatibility), (SELECT count(*) AS n FROM customer)""")
def dr06(spark, d):
    """Four deliveries of the customer table with changing columns."""
    c = S.table(spark, d, "customer")
    deliveries = [c, c, c.withColumn("tier", F.upper("c_mktsegment")), c.drop("c_name")]
    reg = spark.createDataFrame([], "table_name string, version int, schema_json string, changes string, registered_at timestamp, registered_by string")
    out = []
    for i, batch in enumerate(deliveries, 1):
        event, row = registry.detect(spark, reg, "customer", batch.schema, S.EVENTS_AS_OF)
        reg = reg if row is None else reg.unionByName(row)
        out.append(batch.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(event["status"]).alias("status"), F.lit(event["compatibility"]).alias("compatibility"), "n"))
    return registry.union_all(out)


@query("dr07_reaction", "SELECT v.place, CASE v.place WHEN 'target' THEN 2 ELSE 1 END * n AS n FROM (VALUES ('target'), ('quarantine')) v(place), (SELECT count(*) AS n FROM customer)")
def dr07(spark, d):
    c, path = S.table(spark, d, "customer"), work_dir(spark, "customer")
    registry.react(c, path, {"compatibility": "full", "status": "no_change"})
    registry.react(c.withColumn("tier", F.lit("x")), path, {"compatibility": "forward", "status": "field_addition"})
    registry.react(c.drop("c_name"), path, {"compatibility": "breaking", "status": "field_removal"})
    t, q = spark.read.parquet(path), spark.read.parquet(f"{path}_quarantine")
    return t.agg(F.count("*").alias("n")).select(F.lit("target").alias("place"), "n").unionByName(
        q.agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("place"), "n")
    )


@query("dr08_drift_metrics", _LAYOUTS + """
SELECT CASE WHEN layout = before THEN 'full' ELSE 'breaking' END AS compatibility, count(*) AS events
FROM (SELECT layout, lag(layout) OVER (ORDER BY day) AS before FROM layouts) WHERE before IS NOT NULL GROUP BY 1""")
def dr08(spark, d):
    return registry.drift_metrics(registry.day_over_day(documents(spark, d), "doc", "day"), dt.date(2024, 1, 1))


@query("dr09_table_compatibility", """
SELECT 'orders' AS source_table, 'orders_v2' AS target_table, 'breaking' AS compatibility_level, true AS resolution_required, n FROM (SELECT count(*) AS n FROM orders)""")
def dr09(spark, d):
    o = S.table(spark, d, "orders")
    v2 = o.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return registry.compare_tables(o, v2, ("orders", "orders_v2")).drop("issues").withColumn("n", v2.agg(F.count("*")).scalar())


# -- streams ---------------------------------------------------------------

def stream_of(spark, d, path=None):
    schema = S.events(spark, d).schema
    return ingest.file_stream(spark, path or split_files(spark, d), schema, "parquet", max_files=2)


def finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("src01_file_stream", BY_TYPE)
def src01(spark, d):
    target = work_dir(spark, "bronze-events")
    finish(ingest.append_to(ingest.with_lineage(stream_of(spark, d), "events"), target, work_dir(spark, "cp")))
    return by_type(spark.read.parquet(target))


@query("src02_schema_evolution", "SELECT event_type, count(*) AS n, count(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN props END) AS with_props FROM events GROUP BY 1")
def src02(spark, d):
    """A second delivery adds a column; the stream restarts under the wider schema."""
    ev, cut = S.events(spark, d), F.lit(HALF).cast("timestamp_ntz")
    path, target, cp = work_dir(spark, "feed"), work_dir(spark, "evolving"), work_dir(spark, "cp")
    first = ev.where(F.col("ts") < cut).drop("props")
    first.write.mode("append").parquet(path)
    finish(ingest.append_to(ingest.file_stream(spark, path, first.schema, "parquet"), target, cp))
    ev.where(F.col("ts") >= cut).write.mode("append").parquet(path)
    finish(ingest.evolve_and_append(spark, path, target, cp, first.schema, ev.schema))
    return files.read_batch(spark, target, "parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"))


@query("st01_micro_batches", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def st01(spark, d):
    """Stop after the first delivery, add files, resume from the checkpoint: no loss, no repeats."""
    ev, path = S.events(spark, d), work_dir(spark, "feed")
    target, cp = work_dir(spark, "target"), work_dir(spark, "cp")
    for part in (0, 1):
        ev.where(F.col("event_id") % 2 == part).write.mode("append").parquet(path)
        finish(ingest.append_to(ingest.file_stream(spark, path, ev.schema, "parquet", max_files=1), target, cp))
    return spark.read.parquet(target).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query("st02_layer_stream", "SELECT event_type, count(*) AS n, sum(value::decimal(18,2))::double AS total FROM events WHERE value > 10 AND user_id IS NOT NULL GROUP BY 1")
def st02(spark, d):
    upstream, target = split_files(spark, d), work_dir(spark, "silver-events")
    rules = E.from_sql({"has_user": "user_id IS NOT NULL", "large": "value > 10"}, "drop")
    finish(ingest.layer_stream(spark, upstream, target, work_dir(spark, "cp"), rules))
    return by_type(spark.read.parquet(target))


@query("st03_full_refresh", BY_TYPE)
def st03(spark, d):
    """A refresh under a new checkpoint reads everything again into a new target."""
    path = split_files(spark, d)
    finish(ingest.append_to(stream_of(spark, d, path), work_dir(spark, "old"), work_dir(spark, "cp")))
    fresh = work_dir(spark, "fresh")
    finish(ingest.refresh(lambda: stream_of(spark, d, path), fresh, work_dir(spark, "cp")))
    return by_type(spark.read.parquet(fresh))


@query("st04_stream_quality", "SELECT 'value' AS field, 'positive' AS rule, count(*) AS total, count(*) FILTER (WHERE value > 20) AS passed FROM events")
def st04(spark, d):
    from dqflow.operators.rules import Rule, RuleSet

    rules = RuleSet().register(Rule("positive", "validity", "critical", "field_value > 20", ("value",)))
    log = work_dir(spark, "quality-log")
    finish(ingest.quality_checks(stream_of(spark, d), rules, log, work_dir(spark, "cp")))
    return spark.read.parquet(log).groupBy("field", "rule").agg(F.sum("total_count").alias("total"), F.sum("passed_count").alias("passed"))


@query("st06_stream_duplicates", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def st06(spark, d):
    """Every third event arrives twice; the stream keeps the first."""
    ev, path = S.events(spark, d), work_dir(spark, "feed")
    ev.unionByName(ev.where("event_id % 3 = 0")).write.parquet(path)
    target = work_dir(spark, "deduplicated")
    stream = windows.first_seen(ingest.file_stream(spark, path, ev.schema, "parquet"), ["event_id"], "ts", "40 days")
    finish(ingest.append_to(stream, target, work_dir(spark, "cp")))
    return spark.read.parquet(target).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query("st07_tumbling", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def st07(spark, d):
    """Hourly counts; windows the watermark has not closed yet stay in state."""
    target = work_dir(spark, "hourly")
    stream = ingest.file_stream(spark, d, S.events(spark, d).schema, "parquet", pathGlobFilter="events.parquet")
    finish(ingest.append_to(windows.tumbling(stream, "ts", "1 hour", "10 minutes", ["event_type"]), target, work_dir(spark, "cp")))
    return spark.read.parquet(target).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("st08_sliding", """
SELECT strftime(w, '%Y-%m-%d') AS window_start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events)
WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1""")
def st08(spark, d):
    target = work_dir(spark, "weekly")
    stream = ingest.file_stream(spark, d, S.events(spark, d).schema, "parquet", pathGlobFilter="events.parquet")
    finish(ingest.append_to(windows.sliding(stream, "ts", "7 days", "1 day", "10 minutes"), target, work_dir(spark, "cp")))
    return spark.read.parquet(target).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("st10_stream_suppression", """
SELECT rule, count(DISTINCT tenant_id) AS n FROM rule_alerts WHERE rule IN ('high_usage_warning', 'usage_limit_critical', 'pipeline_failure_rate', 'api_response_time') GROUP BY 1""")
def st10(spark, d):
    """First alert per rule and tenant within the suppression window.

    The feed arrives as one batch here, in which the watermark stands still:
    each rule and tenant raises one alert.
    """
    from dqflow.operators.alerts import check_rules

    path = work_dir(spark, "metrics")
    S.metrics(spark, d).write.parquet(path)
    stream = ingest.file_stream(spark, path, spark.read.parquet(path).schema, "parquet")
    target = work_dir(spark, "alerts")
    raised = windows.first_seen(check_rules(stream), ["rule", "tenant_id"], "timestamp", "60 minutes")
    finish(ingest.append_to(raised, target, work_dir(spark, "cp")))
    return spark.read.parquet(target).groupBy("rule").agg(F.count("*").alias("n"))


@query("st11_late_data", "SELECT submission_date > date_of_service + 90 AS late, count(*) AS n FROM claims WHERE date_of_service IS NOT NULL GROUP BY 1")
def st11(spark, d):
    path, target = work_dir(spark, "claims"), work_dir(spark, "claims-late")
    S.claims(spark, d).write.parquet(path)
    stream = ingest.file_stream(spark, path, spark.read.parquet(path).schema, "parquet").where("date_of_service IS NOT NULL")
    flagged = stream.withColumn("late", windows.late_flag("date_of_service", "submission_date", 90))
    finish(ingest.append_to(flagged, target, work_dir(spark, "cp")))
    return spark.read.parquet(target).groupBy("late").agg(F.count("*").alias("n"))


@query("pl10_run", """
SELECT 'claims' AS feed, count(*) AS records, sum(q10) / 10.0::double / count(*) AS quality_score, 'SUCCESS' AS status FROM scored WHERE record_id IS NOT NULL""")
def pl10(spark, d):
    """One run: ingest as a stream, build bronze, assess it, record the run."""
    from dqflow.operators import marts as M
    from dqflow.operators import scores as SC
    from dqflow.plans import medallion as L

    landing, raw = work_dir(spark, "landing"), work_dir(spark, "raw")
    S.raw_claims(spark, d).write.parquet(landing)
    stream = ingest.file_stream(spark, landing, spark.read.parquet(landing).schema, "parquet")
    finish(ingest.append_to(stream, raw, work_dir(spark, "cp")))
    bronze = L.bronze_claims(spark.read.parquet(raw), S.CLAIMS_AS_OF)
    scored = bronze.withColumns({"_quality_score": SC.quality_score(), "_anomaly_score": SC.anomaly_score()})
    return M.table_metrics(scored).select(
        F.lit("claims").alias("feed"), F.col("total_records").alias("records"), F.col("avg_quality_score").alias("quality_score"), F.lit("SUCCESS").alias("status")
    )



