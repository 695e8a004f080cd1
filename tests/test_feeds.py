"""Streams with keyed state, inferred and evolving feeds, fields of nested documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow import shapes as S
from dqflow.catalog import feeds
from dqflow.session import work_dir
from dqflow.sources import registry
from dqflow.streaming import inferred, ingest, stateful


def test_suppression_does_not_depend_on_deliveries(spark, sf):
    one, three, ten = ({tuple(r) for r in feeds.suppressed(spark, sf, n).collect()} for n in (1, 3, 10))
    assert len(one) > 50 and one == three == ten and any(r[-2] for r in one) and not all(r[-2] for r in one)


def test_lifecycle_ignores_illegal_events_and_memory_expires(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", "acknowledge", t(0), 1), ("a", "trigger", t(1), 2), ("a", "acknowledge", t(2), 3), ("a", "trigger", t(3), 4), ("a", "resolve", t(4), 5),
            ("a", "acknowledge", t(5), 6), ("b", "trigger", t(6), 7), ("b", "resolve", t(7), 8), ("c", "trigger", None, 9), ("a", "trigger", t(60 * 80), 10),
            ("z", "trigger", t(60 * 200), 11)]
    path = work_dir(spark, "alerts")
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, "alert_id string, action string, timestamp timestamp_ntz, event_id bigint").coalesce(1).write.mode("append").parquet(path)
    out = feeds.stream_through(spark, path, lambda s: stateful.lifecycle_stream(s, "10 minutes"))
    got = sorted((r["alert_id"], r["event_id"], r["status"]) for r in out.collect())
    # After 48 hours without events an alert is forgotten, so its next trigger opens it again.
    assert got == [("a", 2, "triggered"), ("a", 3, "acknowledged"), ("a", 5, "resolved"), ("a", 10, "triggered"), ("b", 7, "triggered"), ("b", 8, "resolved")]


def test_schema_is_inferred_once_and_kept(spark):
    path, location = work_dir(spark, "docs"), work_dir(spark, "schema")
    spark.createDataFrame([('{"a": 1, "b": {"c": [1]}}',)], "value string").write.text(path)
    first = inferred.stored_schema(spark, path, "json", location)
    spark.createDataFrame([('{"a": "x", "d": 1}',)], "value string").write.mode("append").text(path)
    assert inferred.stored_schema(spark, path, "json", location) == first
    with pytest.raises(ValueError):
        inferred.stored_schema(spark, path, "orc", work_dir(spark, "none"))


def test_rescued_column_keeps_what_does_not_fit(spark):
    docs = ['{"a": 1, "b": {"c": [1]}}', '{"a": "x", "b": 5, "d": 1}', '{"a": null}', "{broken", "", None, "[1]", '{"a": 12345678901234567890}', '{"b": {"c": ["x"]}}', '{"b": {"c": [2], "new": 7}}']
    rows = spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "value string, extra int")
    schema = T.StructType.fromDDL("a bigint, b struct<c: array<bigint>>")
    got = {r["extra"]: r for r in inferred.typed_documents(rows, schema).collect()}
    assert got[0]["a"] == 1 and got[0]["b"]["c"] == [1] and got[0]["_rescued"] is None
    assert got[1]["a"] is None and '"a":"x"' in got[1]["_rescued"] and '"d":"1"' in got[1]["_rescued"] and '"b":"5"' in got[1]["_rescued"]
    assert got[2]["_rescued"] is None and "{broken" in got[3]["_rescued"] and got[5]["_rescued"] is None
    assert '\\"x\\"' in got[8]["_rescued"] and got[8]["b"] is None and "new" in got[9]["_rescued"]
    assert "[1]" in got[6]["_rescued"] and "12345678901234567890" in got[7]["_rescued"]


def test_evolution_rules():
    s = T.StructType.fromDDL
    known = s("a bigint, b string")
    assert inferred.evolution(None, known) == ("wider", known)
    assert inferred.evolution(known, s("a bigint"))[0] == "same" and inferred.evolution(known, s("a void, b string"))[0] == "same"
    assert inferred.evolution(known, s("a double")) == ("wider", s("a double, b string"))
    assert inferred.evolution(s("a double"), s("a bigint"))[0] == "same"
    assert inferred.evolution(known, s("b bigint"))[0] == "breaking"
    assert inferred.evolution(known, s("a bigint, c boolean")) == ("wider", s("a bigint, b string, c boolean"))


def test_failed_ingest_is_run_again_without_repeats(spark, monkeypatch):
    path, target, cp, reg = (work_dir(spark, n) for n in ("feed", "evolved", "cp", "registry"))
    spark.createDataFrame([('{"a": 1}',)] * 5, "value string").write.text(path)
    written = inferred.typed_documents
    monkeypatch.setattr(inferred, "typed_documents", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        inferred.evolving_ingest(spark, "t", path, target, cp, reg, dt.datetime(2024, 1, 1))
    monkeypatch.setattr(inferred, "typed_documents", written)
    assert inferred.evolving_ingest(spark, "t", path, target, cp, reg, dt.datetime(2024, 1, 1)) == ["same"]
    assert inferred.evolving_ingest(spark, "t", path, target, cp, reg, dt.datetime(2024, 1, 1)) == []
    assert spark.read.parquet(target).count() == 5 and inferred.read_registry(spark, reg).count() == 1


def test_fields_at_every_depth(spark):
    docs = ['{"a":1,"b":{"c":"x","d":[1,2.5]},"m":{"k1":1,"k2":null}}', '{"a":2,"b":{"c":null,"d":[{"e":true}]},"z":"12"}', "nojson", "", None, "3"]
    df = spark.createDataFrame([(d, i % 2) for i, d in enumerate(docs)], "doc string, side int")
    got = {r["path"]: (r["type"], r["nullable"]) for r in registry.observed_fields(df, "doc", maps=["m"]).collect()}
    assert got == {"a": ("bigint", False), "b": ("struct", False), "b.c": ("string", True), "b.d": ("array", False), "b.d[]": ("string", False),
                   "b.d[].e": ("boolean", False), "m": ("struct", True), "m{}": ("bigint", True), "z": ("string", True)}
    sides = registry.observed_fields(df, "doc", ["side"], depth=1)
    assert {(r["side"], r["path"]) for r in sides.collect()} == {(0, "a"), (0, "b"), (0, "m"), (1, "a"), (1, "b"), (1, "z")}
    assert registry.observed_fields(df.where("false"), "doc").count() == 0
    nested = T.StructType.fromDDL("a array<map<string, struct<b: int>>>")
    assert [r[0] for r in registry.flatten(nested)] == ["a", "a[]{}.b"]


def test_keys_of_a_bucket_share_one_call(spark):
    """Many keys take a few calls of the fold, and one bucket for all gives what a bucket for each gives."""
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(f"k{i}" if i else None, t(7 * i % 50 + 40 * j + 3000 * (j // 3)), i * 10 + j) for i in range(60) for j in range(6)]
    path = work_dir(spark, "bucketed")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "k string, at timestamp_ntz, n bigint").coalesce(1).write.mode("append").parquet(path)

    def fold(rows, part, memory):
        import pandas as pd

        total, out = [m or 0 for m in memory], []
        for p, n in zip(part, rows["n"]):
            total[p] += 1
            out.append((n, total[p], len(memory)))
        return pd.DataFrame(out, columns=["n", "seen", "keys"]), total

    def run(buckets):
        build = lambda s: stateful.in_event_order(s, ["k"], "at", ["at", "n"], "100 days", fold, "n bigint, seen bigint, keys bigint", 3_600_000, buckets)
        return feeds.stream_through(spark, path, build)

    # The watermark passes nothing but by a row far ahead.
    spark.createDataFrame([("end", t(60 * 24 * 300), 10**6)], "k string, at timestamp_ntz, n bigint").coalesce(1).write.mode("append").parquet(path)
    one, many = run(1).collect(), run(1000).collect()
    assert {(r["n"], r["seen"]) for r in one} == {(r["n"], r["seen"]) for r in many} and len(one) == len(many) == len(rows)
    assert max(r["keys"] for r in one) >= 60
    # A pause of more than an hour forgets what was seen.
    assert {r["n"]: r["seen"] for r in one}[592] == 3 and {r["n"]: r["seen"] for r in one}[593] == 1
