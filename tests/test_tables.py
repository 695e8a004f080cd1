"""Expectations, merges, registry, streams and money."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow import shapes as S
from dqflow.operators import expect as E
from dqflow.plans import medallion as L
from dqflow.session import work_dir
from dqflow.sources import files, merge, registry, tables
from dqflow.streaming import ingest


def test_split_is_a_partition(spark, sf):
    rows = S.raw_claims(spark, sf).withColumns({"_quality_score": F.lit(0.5) + (F.col("k") % 2) * 0.4})
    clean, bad = E.split(rows, L.quarantine_rules(), S.CLAIMS_AS_OF)
    both = clean.unionByName(bad.select(*rows.columns))
    assert both.exceptAll(rows).count() == 0 and rows.exceptAll(both).count() == 0
    assert clean.intersect(bad.select(*rows.columns)).count() == 0


def test_observed_metrics_need_no_second_pass(spark, sf):
    from pyspark.sql import Observation

    rules = E.from_sql({"positive": "value > 0", "large": "value > 20"})
    seen = Observation()
    E.observed(S.events(spark, sf), rules, seen).write.format("noop").mode("overwrite").save()
    want = {r["expectation"]: r["passed_records"] for r in E.expectation_metrics(S.events(spark, sf), rules).collect()}
    assert {k: v for k, v in seen.get.items() if k != "records"} == want


def test_gold_preserves_claims(spark, sf):
    scored = S.claims(spark, sf).withColumns({"_quality_score": F.lit(1.0), "_anomaly_score": F.lit(0.1), "_data_freshness_hours": F.lit(1.0)})
    members = S.members(spark, sf)
    doubled = members.unionByName(members)
    assert L.gold_claims(scored, doubled, S.providers(spark, sf), S.CLAIMS_AS_OF).count() == scored.count()


def test_merge_is_idempotent(spark):
    path = work_dir(spark, "merge-test")
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    s = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "n", 1)], "k int, v string, seq int")
    merge.merge_into(path, t, "k", ["seq"], "1")
    one = merge.merge_into(path, s.where("k IS NOT NULL"), "k", ["seq"], "2").select("k", "v").collect()
    two = merge.merge_into(path, s.where("k IS NOT NULL"), "k", ["seq"], "3").select("k", "v").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) == [(1, "a"), (2, "y"), (3, "z")]
    assert merge.upsert(t, s, "k", ["seq"]).where("k IS NULL").count() == 1
    wide = merge.upsert(t, s.withColumn("extra", F.lit(1)), "k", ["seq"])
    assert "extra" in wide.columns and wide.where("k = 1").first()["extra"] is None


def test_unpublished_version_is_invisible(spark):
    path = work_dir(spark, "versions")
    assert merge.read_current(spark, path) is None
    merge.publish(spark.range(3), path, "1")
    spark.range(99).write.parquet(f"{path}/data/2")
    assert merge.read_current(spark, path).count() == 3


def test_partition_merge_moves_rows(spark):
    path = work_dir(spark, "parts")
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "k int, p string, seq int")
    merge.create_partitions(rows, path, "1", "p")
    out = merge.merge_partitions(path, spark.createDataFrame([(1, "b", 1)], "k int, p string, seq int"), "k", ["seq"], "p", "2")
    assert sorted((r["k"], r["p"]) for r in out.collect()) == [(1, "b"), (2, "b"), (3, "c")]


def schema(**fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


@pytest.mark.parametrize(
    "new,compatibility,change",
    [
        (schema(a=T.IntegerType(), b=T.StringType()), "full", "minor_change"),
        (schema(a=T.IntegerType(), b=T.StringType(), c=T.DateType()), "forward", "field_addition"),
        (schema(a=T.IntegerType()), "breaking", "field_removal"),
        (schema(a=T.LongType(), b=T.StringType()), "breaking", "major_change"),
        (T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType(), True)]), "backward", "minor_change"),
    ],
)
def test_compatibility(spark, new, compatibility, change):
    old = schema(a=T.IntegerType(), b=T.StringType())
    row = registry.judge(registry.diff(registry.schema_rows(spark, old), registry.schema_rows(spark, new))).first()
    assert (row["compatibility"], row["change_type"]) == (compatibility, change)


def test_nested_change_is_located(spark):
    old = schema(s=schema(x=T.IntegerType(), y=T.ArrayType(schema(z=T.StringType()))))
    new = schema(s=schema(x=T.IntegerType(), y=T.ArrayType(schema(z=T.DateType()))))
    rows = registry.diff(registry.schema_rows(spark, old), registry.schema_rows(spark, new)).where("old_type NOT LIKE 'array%'").collect()
    assert [(r["path"], r["change"]) for r in rows] == [("s.y[].z", "data_type_changed")]


def test_reactions(spark):
    path = work_dir(spark, "react")
    broken = {"compatibility": "breaking", "status": "field_removal"}
    spark.range(2).write.parquet(path)
    assert registry.react(spark.range(3), path, broken) == "quarantined"
    assert registry.react(spark.range(3), path, broken, "ignore") == "ignored"
    assert registry.react(spark.range(3), path, broken, "snapshot", dt.datetime(2024, 1, 2, 3, 4, 5)) == "snapshot"
    assert spark.read.parquet(f"{path}_v20240102_030405").count() == 2
    with pytest.raises(ValueError):
        registry.react(spark.range(3), path, broken, "fail")


def test_formats(spark):
    with pytest.raises(ValueError):
        files.read_batch(spark, "x", "avro")
    path = work_dir(spark, "broken-json")
    spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string").coalesce(1).write.text(path)
    rows = files.read_batch(spark, path, "json", "a int, _corrupt_record string")
    assert sorted((r["a"], r["_corrupt_record"]) for r in rows.collect() if r["a"]) == [(1, None)]
    assert rows.cache().where("_corrupt_record IS NOT NULL").count() == 1


def test_layers_are_idempotent(spark):
    first = tables.create_layers(spark, "t_")
    assert tables.create_layers(spark, "t_") == first
    assert spark.table("t_monitoring.job_events").count() == 0


def test_stream_resumes_where_it_stopped(spark, sf):
    ev, path = S.events(spark, sf), work_dir(spark, "feed")
    target, cp = work_dir(spark, "out"), work_dir(spark, "cp")
    for part in range(3):
        ev.where(F.col("event_id") % 3 == part).write.mode("append").parquet(path)
        q = ingest.append_to(ingest.file_stream(spark, path, ev.schema, "parquet"), target, cp)
        q.awaitTermination()
    assert spark.read.parquet(target).exceptAll(ev).count() == 0 and spark.read.parquet(target).count() == ev.count()


def test_unseen_rows(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    seen = spark.createDataFrame([(2, "old")], "k int, v string")
    assert [tuple(r) for r in ingest.unseen(batch, seen, ["k"]).collect()] == [(1, "a")]


def test_invoice_arithmetic(spark):
    from decimal import Decimal as Dec

    from dqflow.operators import usage as U

    acc = spark.createDataFrame(
        [("t1", "starter", "monthly", dt.date(2024, 1, 1), dt.date(2024, 1, 31)), ("t2", "professional", "annual", dt.date(2024, 1, 1), dt.date(2024, 12, 31))],
        "tenant_id string, plan_id string, billing_period string, current_period_start date, current_period_end date",
    )
    use = spark.createDataFrame([("t1", "gb_processed", Dec("150.05")), ("t1", "quality_checks", Dec("10005"))], "tenant_id string, event_type string, quantity decimal(18,6)")
    got = {r["tenant_id"]: r for r in U.invoices(use, acc, dt.date(2024, 2, 1)).collect()}
    # 50.05 * 0.10 = 5.005 -> 5.01 half up; 5 * 0.001 = 0.005 -> 0.01
    assert got["t1"]["total_usage_cost"] == Dec("5.02") and got["t1"]["subtotal"] == Dec("104.02")
    assert got["t1"]["tax_amount"] == Dec("8.32") and got["t1"]["total_amount"] == Dec("112.34")
    assert got["t2"]["base_fee"] == Dec("3229.20") and got["t2"]["total_usage_cost"] == Dec("0.00")
    moved = {r["tenant_id"]: (r["current_period_start"], r["current_period_end"]) for r in U.next_period(acc, dt.date(2024, 2, 1)).collect()}
    assert moved["t1"] == (dt.date(2024, 2, 1), dt.date(2024, 2, 29)) and moved["t2"][1] == dt.date(2024, 12, 31)


def test_retry_policy(spark):
    from dqflow.operators import runs as R

    texts = {
        "Connection reset": "transient_network", "GC overhead, out of memory": "resource_constraint", "cannot parse JSON": "schema_drift",
        "null constraint": "data_quality", "bad credential": "configuration", "who knows": "unknown", None: "unknown",
    }
    df = spark.createDataFrame([(m,) for m in texts], "m string")
    got = {r["m"]: r["c"] for r in df.select("m", R.failure_category(F.col("m")).alias("c")).collect()}
    assert got == texts


def test_profile_of_an_empty_table(spark):
    from dqflow.operators.profile import profile

    rows = profile(spark.createDataFrame([], "a int, b string")).collect()
    assert sorted(r["field"] for r in rows) == ["a", "b"] and all(r["distinct_count"] == 0 for r in rows)


def test_snapshot_quarantines_the_batch(spark, tmp_path):
    import datetime as dt

    from dqflow.sources import registry

    path = f"{tmp_path}/t"
    spark.range(2).write.parquet(path)
    registry.react(spark.range(3), path, {"compatibility": "breaking", "status": "x"}, "snapshot", dt.datetime(2024, 1, 1))
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(f"{path}_quarantine").count() == 3


def test_billing_view_keeps_the_newest_invoices(spark):
    """Seven periods give the five newest, newest first; an account without usage has none; early usage is not billed."""
    from decimal import Decimal

    from dqflow.operators import usage as U

    acc = spark.createDataFrame(
        [("t1", "starter", "monthly", dt.date(2024, 1, 1), dt.date(2024, 1, 31)), ("t2", "starter", "monthly", dt.date(2024, 1, 1), dt.date(2024, 1, 31))],
        "tenant_id string, plan_id string, billing_period string, current_period_start date, current_period_end date")
    metric = U.METRICS[0]
    days = [dt.datetime(2023, 12, 30)] + [dt.datetime(2024, 1, 1 + 3 * i + i % 3, 5) for i in range(7)]
    use = spark.createDataFrame(
        [("t1", metric, Decimal(1), t) for t in days], "tenant_id string, event_type string, quantity decimal(18,6), timestamp timestamp")
    rows = {r["tenant_id"]: r for r in U.billing_view(use, acc, 3).collect()}
    assert [i["period_start"] for i in rows["t1"]["recent_invoices"]] == [dt.date(2024, 1, 1 + 3 * i) for i in (6, 5, 4, 3, 2)]
    assert rows["t1"]["recent_invoices"][0]["period_end"] == dt.date(2024, 1, 21)
    assert [u["quantity"] for u in rows["t1"]["usage"]] == [Decimal(8)]
    assert rows["t2"]["recent_invoices"] == [] and rows["t2"]["usage"] == [] and rows["t2"]["next_billing_date"] == dt.date(2024, 2, 1)
