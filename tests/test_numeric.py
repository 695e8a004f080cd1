"""Percentiles, look-back windows, density noise and forests against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dqflow.operators import drift as D
from dqflow.operators import multivariate as M
from dqflow.operators import timeline as TL
from dqflow.operators.quantiles import exact_percentiles

PS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}


def check_percentiles(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: [r[k] for k in PS] for r in exact_percentiles(df, "g", "v", PS).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx([np.quantile(vs, p) for p in PS.values()]), g


def test_percentiles_by_group(spark):
    rng = np.random.default_rng(1)
    check_percentiles(
        spark,
        {
            "hot": np.round(rng.exponential(100, 20000), 1),
            "copies": np.array([5.0] * 3000 + [6.0]),
            "single": np.array([3.0]),
            "two": np.array([1.0, 2.0]),
            "negative": rng.normal(-1e6, 1e5, 500),
        },
    )


def test_percentiles_global_weighted_and_null(spark):
    vs = np.random.default_rng(2).integers(0, 50, 4000)
    df = spark.createDataFrame([(float(v),) for v in vs] + [(None,)] * 10, "v double")
    row = exact_percentiles(df, [], "v", PS).first()
    assert [row[k] for k in PS] == pytest.approx([np.quantile(vs, p) for p in PS.values()]) and row["_n"] == 4000
    folded = df.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("w"))
    row = exact_percentiles(folded, [], "v", PS, weight="w").first()
    assert [row[k] for k in PS] == pytest.approx([np.quantile(vs, p) for p in PS.values()])


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def history(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice("aab"), day(rnd.randrange(120)), rnd.randrange(9), i, rnd.random() < 0.3) for i in range(n)]


@pytest.fixture(scope="module")
def events(spark):
    rows = history(5)
    return rows, spark.createDataFrame(rows, "k string, d date, v int, i int, off boolean")


def test_trailing(events):
    rows, df = events
    n = {(r["k"], r["d"]): r["n"] for r in TL.trailing_count(df, "k", "d", 10, "n").collect()}
    u = {(r["k"], r["d"]): r["u"] for r in TL.trailing_distinct(df, "k", "d", "v", 10, "u").collect()}
    for k, d in {(r[0], r[1]) for r in rows}:
        near = [r for r in rows if r[0] == k and d - dt.timedelta(days=10) <= r[1] <= d]
        assert n[k, d] == len(near) and u[k, d] == len({r[2] for r in near})


def test_earlier_within(events):
    rows, df = events
    out = TL.flag_earlier_within(df, "k", "d", 2, "f", counts=~F.col("off"), ident="i").collect()
    for r in out:
        want = any(
            o[0] == r["k"] and o[3] != r["i"] and not o[4] and r["d"] - dt.timedelta(days=2) <= o[1] <= r["d"] for o in rows
        )
        assert r["f"] is want


def test_not_first(events):
    rows, df = events
    out = TL.flag_not_first(df, ["k", "v"], ["d", "i"], "f", min_rows=1).collect()
    for r in out:
        assert r["f"] is any(o[0] == r["k"] and o[2] == r["v"] and (o[1], o[3]) < (r["d"], r["i"]) for o in rows)


def test_interval_cover(spark):
    rnd = random.Random(9)
    spans = [(rnd.choice("ab"), day(s), None if rnd.random() < 0.05 else day(s + rnd.randrange(-2, 12))) for s in rnd.choices(range(200), k=40)]
    df = spark.createDataFrame(spans, "k string, s date, e date")
    points = spark.createDataFrame([(k, day(n)) for k in "abc" for n in range(0, 230)], "k string, d date")
    out = TL.flag_covered(points, df, "k", "d", "s", "e", dt.date(2099, 12, 31), "f").collect()
    for r in out:
        assert r["f"] is any(k == r["k"] and s <= r["d"] <= (e or dt.date(2099, 12, 31)) for k, s, e in spans)


def test_slots(spark):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice("aab"), base + dt.timedelta(seconds=rnd.randrange(40000)), i, rnd.random() < 0.4) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, ok boolean").repartition(4)
    slot = F.date_trunc("hour", "t")
    out = TL.sequence_in_slots(df, "k", slot, ["t", "i"], "seq")
    out = TL.lag_in_slots(out, "k", "t", slot, ["t", "i"], "i", "prev")
    out = TL.last_before_in_slots(out, "k", slot, ["t", "i"], F.when("ok" == F.lit("x"), 0).otherwise(F.when(F.col("ok"), F.col("i"))), "good")
    out = TL.trailing_in_slots(out, "k", F.unix_micros(F.col("t").cast("timestamp")), 3600, "recent").collect()
    for k in "ab":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        got = {r["i"]: r for r in out if r["k"] == k}
        assert len(got) == len(mine)
        for n, r in enumerate(mine):
            g = got[r[2]]
            assert g["seq"] == n + 1 and g["prev"] == (mine[n - 1][2] if n else None)
            before = [x[2] for x in mine[:n] if x[3]]
            assert g["good"] == (before[-1] if before else None)
            assert g["recent"] == sum(r[1] - dt.timedelta(hours=1) < x[1] <= r[1] for x in mine)


def brute_noise(x, eps=0.5, min_samples=5):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    near = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_samples
    return ~core & ~(near & core[None, :]).any(axis=1)


@pytest.mark.parametrize("dims,seed", [(1, 0), (2, 1), (2, 2), (3, 3)])
def test_density_noise(spark, dims, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.3, (300, dims)), rng.normal(4, 0.5, (120, dims)), rng.uniform(-12, 16, (70, dims)), np.zeros((10, dims))])
    x = np.round(x, 3)
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(6)
    row = M.noise_summary(df, cols).first()
    assert row["total_records"] == len(x) and row["anomaly_count"] == int(brute_noise(x).sum())


def test_forest(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (2000, 2)), rng.normal(30, 0.5, (20, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    one = M.isolation_scores(df.repartition(3), ["a", "b"], trees=20).toPandas()
    two = M.isolation_scores(df.repartition(7), ["a", "b"], trees=20).toPandas()
    key = ["x0", "x1"]
    pd.testing.assert_frame_equal(one.sort_values(key).reset_index(drop=True), two.sort_values(key).reset_index(drop=True))
    far = one["x0"] > 15
    assert one.loc[far, "score"].min() > one.loc[~far, "score"].quantile(0.97)
    s = M.forest_summary(df, ["a", "b"], trees=20).first()
    assert s["total_records"] == 2020 and 150 < s["anomaly_count"] <= 202


def test_drift_properties(spark):
    a = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    b = spark.range(1000).select((F.col("id") % 10 + 100).cast("double").alias("x"), F.lit("z").alias("c"))
    assert all(abs(r["js_divergence"]) < 1e-12 for r in D.drift(a, a, ["x"], ["c"]).collect())
    assert all(r["js_divergence"] == pytest.approx(1.0) for r in D.drift(a, b, ["x"], ["c"]).collect())


@pytest.mark.parametrize("rows", [100_000, 300])
def test_forest_with_few_distinct_values(spark, rows):
    """Nearly all rows equal and ten far out: the ten are found and no score is NULL."""
    far = F.when(F.col("id") < 10, 1000.0 + F.col("id")).otherwise(F.lit(1.0))
    df = spark.range(rows).select(far.alias("a"), F.lit(2.0).alias("b"))
    scored = M.isolation_scores(df, ["a", "b"]).collect()
    assert all(r["score"] is not None for r in scored)
    assert min(r["score"] for r in scored if r["x0"] > 1) > max(r["score"] for r in scored if r["x0"] == 1)
    assert M.forest_summary(df, ["a", "b"]).first()["anomaly_count"] == 10


def test_forest_on_constant_and_on_discrete_data(spark):
    same = spark.range(500).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    assert [round(r["score"], 6) for r in M.isolation_scores(same, ["a", "b"]).collect()] == [0.5]
    grid = spark.range(20_000).select((F.col("id") % 20).cast("double").alias("a"), (F.floor(F.col("id") / 20) % 21).cast("double").alias("b"))
    out = grid.unionByName(spark.range(5).select(F.lit(500.0).alias("a"), F.lit(-500.0).alias("b")))
    top = M.isolation_scores(out, ["a", "b"]).orderBy(F.desc("score")).first()
    assert (top["x0"], top["x1"]) == (500.0, -500.0)


def test_one_crowded_hour_is_spread_over_slots(spark):
    """All rows in one hour of one key: narrow slots, same results as plain windows."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.pow(F.col("id"), F.lit(2.0)).cast("bigint") * 30)
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("i"), at.alias("t"))
    micros = F.unix_micros("t")
    slots = df.groupBy(TL.even_slot(df, "k", micros, 50)).count().collect()
    assert max(r["count"] for r in slots) <= 100 and len(slots) > 30
    slot = TL.even_slot(df, "k", micros, 50)
    out = TL.lag_in_slots(TL.sequence_in_slots(df, "k", slot, ["t", "i"], "seq"), "k", "t", slot, ["t", "i"], "i", "prev")
    assert all(r["seq"] == r["i"] + 1 and r["prev"] == (r["i"] - 1 if r["i"] else None) for r in out.collect())
    rows = TL.trailing_in_slots(df, "k", micros, 10, "recent", rows_per_slot=50).collect()
    times = {r["i"]: r["t"] for r in rows}
    for i in (0, 1, 500, 2999):
        assert next(r["recent"] for r in rows if r["i"] == i) == sum(times[i] - dt.timedelta(seconds=10) < t <= times[i] for t in times.values())
