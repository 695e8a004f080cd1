"""Hot-key paths give the same rows as plain joins and really use the salt."""

import random

import pytest
from pyspark.sql import functions as F

from dqflow.operators import skew


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows on one key, a third without key, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(3000).repartition(8).select("id", key.cast("int").alias("k"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("min_rows", [1, 500, 10**9])
def test_join_unique(spark, fact, how, min_rows):
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"))
    got = skew.join_unique(fact, dim, "k", how, min_rows=min_rows)
    want = fact.join(dim, "k", how).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attach_stats(spark, fact):
    got = skew.attach_stats(fact, "k", [F.count(F.lit(1)).alias("n"), F.max("id").alias("m")], min_rows=100)
    stats = fact.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    want = fact.join(stats, "k", "left").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_salt_is_part_of_the_shuffle(spark, fact):
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.join_unique(fact, dim, "k", min_rows=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("__salt" in line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line)


def test_hot_rows_are_spread(spark, fact):
    """Rows of the hot key and of the NULL key reach many partitions of the salted shuffle."""
    hot = skew.hot_keys(fact, "k", min_rows=500)
    assert [r["k"] for r in hot.collect()] == [7]
    spread = F.spark_partition_id() + 1
    salted = fact.withColumn("s", F.when((F.col("k") == 7) | F.col("k").isNull(), spread).otherwise(F.lit(0)))
    sizes = salted.repartition(8, "k", "s").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 3000 / 2


def test_hot_list_is_bounded_by_the_share(spark, fact):
    many = spark.range(10000).select((F.col("id") % 5000).alias("k"))
    assert skew.hot_keys(many, "k").count() == 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = spark.range(10000).select((F.col("id") % 3).alias("k"))
    assert skew.hot_keys(few, "k").count() == 3 <= skew.HOT_SHARE * partitions
    # The share does not depend on the number of rows.
    assert [r["k"] for r in skew.hot_keys(fact, "k").collect()] == [7]


def test_extreme_per_key_with_maps(spark):
    df = spark.sql("SELECT 1 AS k, 2 AS t, map('a', 1, 'b', 2) AS m UNION ALL SELECT 1, 1, map('z', 9) UNION ALL SELECT 2, 5, CAST(NULL AS map<string,int>)")
    assert sorted((r["k"], r["t"], r["m"]) for r in skew.last_per_key(df, "k", ["t"]).collect()) == [(1, 2, {"a": 1, "b": 2}), (2, 5, None)]


def test_first_per_key_keeps_one_of_full_copies(spark):
    rows = [(1, "a", 5)] * 400 + [(1, "b", 5)] * 10 + [(2, "z", 1)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, v string, t int")
    assert sorted(map(tuple, skew.first_per_key(df, "k", ["t"]).collect())) == [(1, "a", 5), (2, "z", 1)]
    assert sorted(map(tuple, skew.last_per_key(df, "k", ["t"]).collect())) == [(1, "b", 5), (2, "z", 1)]


def test_flag_member(spark, fact):
    listed = spark.createDataFrame([(7,), (7,), (8,), (None,)], "k int")
    got = skew.flag_member(fact, listed, "k", "hit", min_rows=1)
    assert got.count() == 3000
    assert got.where("hit").count() == fact.where("k IN (7, 8)").count()


@pytest.mark.parametrize("small", [0, 10**6])
def test_look_up_and_flag(spark, monkeypatch, small):
    """Hot members, a hot group, NULL keys and members that are not looked up: as by plain joins."""
    monkeypatch.setattr(skew, "SMALL_ROWS", small)
    rows = [(None if i % 11 == 0 else 1 if i % 3 == 0 else 2 if i % 3 == 1 else i % 97, None if i % 13 == 0 else 0 if i % 2 else i % 40, i * 7919 % 500, i) for i in range(4000)]
    fact = spark.createDataFrame(rows, "k int, g int, t int, id int").repartition(6)
    dim = spark.createDataFrame([(i, f"m{i}") for i in range(0, 90, 2)], "k int, a string")
    got = {r["id"]: (r["a"], r["f"]) for r in skew.look_up_and_flag(fact, dim, "k", ["k", "g"], ["t", "id"], "f").collect()}
    least = {}
    for k, g, t, i in rows:
        least[k, g] = min(least.get((k, g), (t, i)), (t, i))
    names = {i: f"m{i}" for i in range(0, 90, 2)}
    assert got == {i: (names.get(k), k is not None and g is not None and (t, i) > least[k, g]) for k, g, t, i in rows}


def test_look_up_and_flag_deals_the_rows_once(spark, fact, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    rows = fact.withColumns({"g": F.col("id") % 9, "wide": F.lit("x")})
    dim = spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("a"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.look_up_and_flag(rows, dim, "k", ["k", "g"], ["id"], "f")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Both sides of the look-up, and none for the flag.
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__salt" in line]) == 2


def test_distinct_counts_of_hot_and_other_groups(spark):
    from dqflow.operators import marts

    rows = [(None if i % 5 == 0 else 1 if i % 2 else i % 300, i % 3, i % 17, None if i % 4 else i % 23) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, m int, a int, b int")
    got = marts.per_group(df, "k", ["k", "m"], [F.count(F.lit(1)).alias("n")], {"as": "a", "bs": "b"})
    want = df.groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("as"), F.countDistinct("b").alias("bs"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.dtypes == want.dtypes


def test_what_is_known_by_member_is_one_look_up(spark, sf):
    """Claims travel by member once, whatever number of facts and covers is looked up there (each look-up has one salt)."""
    from dqflow.catalog import QUERIES

    for name, lookups in (("jn02_eligibility", 1), ("jn18_eligibility_lookup", 2)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().analyzed().toString()
        assert plan.lower().count("spark_partition_id()") == lookups
