"""Resumed runs, replay-safe live totals, mergeable history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dqflow import shapes as S
from dqflow.catalog import layout
from dqflow.operators import history as H
from dqflow.plans import journal as J
from dqflow.session import work_dir
from dqflow.streaming import ingest


@pytest.mark.parametrize("broken", [{"ingest": 1}, {"bronze": 2}, {"assess": 1}, {}])
def test_a_run_resumes_where_it_failed(spark, sf, broken):
    path, left, ran = work_dir(spark, "run"), dict(broken), []
    failures = sum(broken.values())
    steps = [(n, lambda r, n=n, w=w: (ran.append(n), w(r))[1]) for n, w in layout.claim_steps(spark, sf, left)]
    for _ in range(failures):
        with pytest.raises(ValueError):
            J.run_steps(spark, path, "r", steps)
    assert not failures or J.run_record(spark, path, 3).first()["status"] == "FAILED"
    record = J.run_steps(spark, path, "r", steps).first()
    assert (record["status"], record["steps_done"], record["attempts"], record["failures"]) == ("SUCCESS", 3, 3 + failures, failures)
    before = list(ran)
    J.run_steps(spark, path, "r", steps)
    assert ran == before and record["records"] == 1 and record["ended_at"] >= record["started_at"]
    reasons = {r["reason"] for r in J.entries(spark, path).where("status = 'FAILED'").collect()}
    assert reasons == ({"missing_source"} if failures else set())
    J.run_steps(spark, path, "other", layout.claim_steps(spark, sf, {}))
    assert J.run_record(spark, path, 3).count() == 2


def test_live_totals_survive_a_kill_between_write_and_commit(spark, sf, monkeypatch):
    usage = S.usage_events(spark, sf).drop("metadata")
    path, target, cp = layout.in_deliveries(spark, usage, "timestamp", 3, "usage"), work_dir(spark, "live"), work_dir(spark, "cp")
    plain, calls = ingest.for_each, []

    def failing(df, handle, *a):
        def once(batch, number):
            handle(batch, number)
            calls.append(number)
            if calls.count(1) == 1 and number == 1:
                raise RuntimeError("killed")
        return plain(df, once, *a)

    monkeypatch.setattr(ingest, "for_each", failing)
    with pytest.raises(Exception):
        layout.finish(layout.live_usage(spark, path, target, cp))
    layout.finish(layout.live_usage(spark, path, target, cp))
    assert calls.count(1) == 2
    got = ingest.read_live(spark, target, ["hour", "tenant_id", "event_type"]).agg(F.sum("quantity"), F.count("*")).first()
    want = usage.groupBy(F.date_trunc("hour", "timestamp"), "tenant_id", "event_type").agg(F.sum("quantity").alias("q")).agg(F.sum("q"), F.count("*")).first()
    assert tuple(got) == tuple(want)


def test_history_merges_and_replays(spark):
    rows = spark.range(60_000).select(
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(days=(F.col("id") % 60).cast("int"))).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("double").alias("x"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("y"))
    path = work_dir(spark, "history")
    H.append_days(rows.where(F.col("ts") < F.lit(dt.datetime(2024, 2, 5))), path, "ts", ["x", "y"])
    H.append_days(rows.where(F.col("ts") >= F.lit(dt.datetime(2024, 2, 3))), path, "ts", ["x", "y"])
    for g in ("day", "week", "month"):
        for r in H.rolled_up(spark.read.parquet(path), g).collect():
            window = rows.where(F.date_trunc(g, "ts").cast("date") == F.lit(r["window_start"])).select(r["column_name"]).toPandas().iloc[:, 0]
            held = window.dropna()
            assert r["records"] == len(window) and r["null_count"] == window.isna().sum() and r["mean"] == pytest.approx(held.mean())
            assert r["stddev"] == pytest.approx(held.std()) and r["min_value"] == held.min() and r["max_value"] == held.max()
            assert abs(r["distinct_estimate"] - held.nunique()) <= H.DISTINCT_ERROR * held.nunique() + 1
            for share, q in zip((0.25, 0.5, 0.75), r["quantiles"]):
                assert (held < q).mean() - H.RANK_ERROR - 1 / len(held) <= share <= (held <= q).mean() + H.RANK_ERROR + 1 / len(held)
            if r["window_start"] > dt.date(2024, 2, 10) and g == "day":
                break
