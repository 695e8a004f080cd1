"""Report tables by hand: findings, trend, monitor bundle, programme rules."""

import datetime as dt

from pyspark.sql import functions as F

from dqflow.functions import codes as C
from dqflow.operators import anomaly as A
from dqflow.operators import reports as R


def test_programme_errors(spark):
    rows = [("CA", "KAISER", None, 50000), ("CA", "OTHER", "09", 50001), ("CA", None, None, None), ("TX", None, "03", 99999),
            ("TX", "KAISER", None, 1), ("NY", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "state string, plan string, dual string, amount int")
    got = [r[0] for r in df.select(C.state_programme_errors("state", "plan", "dual", "amount")).collect()]
    assert got == [[], ["plan", "claim_amount"], ["plan", "claim_amount"], [], ["dual_code"], [], []]


def test_trend_of_the_newest_month(spark):
    rows = [(dt.date(2024, 1, 3), "a", None), (dt.date(2024, 1, 9), "a", "x"), (dt.date(2024, 2, 1), "a", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "day date, f string, g string")
    r = R.quality_trend(df, "day", ["f", "g"]).collect()[0]
    assert (r["period"][:7], r["records"], r["avg_score"], r["previous_score"], r["trend"], r["gap_to_target"]) == ("2024-02", 1, 100.0, 75.0, "up", -5.0)
    assert R.quality_trend(df.limit(0), "day", ["f"]).collect()[0]["periods"] == 0


def test_monitor_bundle_parts(spark):
    rows = [(dt.datetime(2024, 1, d, h), float(h * d) if h else None) for d in (1, 2, 3) for h in range(6)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double")
    out = R.monitor_bundle(df, "ts", "value", F.lit(dt.date(2024, 1, 2)).cast("timestamp_ntz"))
    got = {(r["part"], r["at"], r["name"]): r["value"] for r in out.collect()}
    assert got["metric", "2024-01-02 00:00", "records"] == 6 and got["profile", "2024-01-03 00:00", "nulls"] == 1
    assert got["profile", "2024-01-03 00:00", "high"] == 15 and got["summary", None, "records"] == 12
    assert not any(at and at < "2024-01-02" for _, at, _ in got)


def test_findings_report(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(400)] + [(1000.0,), (None,)], "x double")
    rows = A.report(A.z_score(df, "t", ["x"]), 5).collect()
    by = {s: [r for r in rows if r["section"] == s] for s in ("by severity", "by anomaly_type", "top", "advice")}
    assert [r["value"] for r in by["top"]] == [1] and by["top"][0]["name"].endswith("z_score x") and by["top"][0]["position"] == 1
    assert len(by["advice"]) == 2 and by["by anomaly_type"][0]["name"] == "statistical_outlier"
    assert A.report(A.z_score(df.limit(0), "t", ["x"])).count() == 0
