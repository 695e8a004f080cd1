"""Versioned file tables: merge by file, replay, time travel, clean-up, Z-order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dqflow.session import work_dir
from dqflow.sources import filetable as FT

AT = dt.datetime(2024, 1, 1)


def later(days):
    return AT + dt.timedelta(days=days)


@pytest.fixture()
def table(spark):
    path = work_dir(spark, "table")
    FT.create(spark.range(10_000).select("id", (F.col("id") * 2).alias("v"), F.lit(0).alias("seq")), path, "id", AT, 50)
    return path


def test_merge_touches_few_files_and_replays_to_nothing(spark, table):
    source = spark.range(2000, 2100).select("id", F.lit(-1).cast("bigint").alias("v"), F.lit(1).alias("seq"))
    source = source.unionByName(source.withColumns({"v": F.lit(-2).cast("bigint"), "seq": F.lit(2)}))
    one = FT.merge(table, source, "id", ["seq"], later(1))
    assert one["files"] == 50 and 1 <= one["rewritten"] <= 2 and one["version"] == 2
    assert FT.merge(table, source, "id", ["seq"], later(2))["version"] == 2
    now = FT.read(spark, table)
    assert now.count() == 10_000 and now.where("v = -2").count() == 100 and now.where("v = -1").count() == 0
    older = FT.merge(table, source.where("seq = 1").withColumn("seq", F.lit(0)), "id", ["seq"], later(2))
    assert older["added"] == 0


def test_merge_of_new_null_and_scattered_keys(spark, table):
    rows = [(i, -5, 1) for i in (0, 9_999, 20_000)] + [(None, -5, 1)]
    out = FT.merge(table, spark.createDataFrame(rows, "id bigint, v bigint, seq int"), "id", ["seq"], later(1))
    now = FT.read(spark, table)
    assert out["rewritten"] == 2 and now.count() == 10_002 and now.where("v = -5").count() == 4 and now.where("id IS NULL").count() == 1
    wide = spark.createDataFrame([(1, -6, 2, "x")], "id bigint, v bigint, seq int, extra string")
    FT.merge(table, wide, "id", ["seq"], later(2))
    assert FT.read(spark, table).where("extra = 'x'").count() == 1 and FT.read(spark, table, 1).count() == 10_000


def test_failed_commit_is_invisible(spark, table):
    spark.range(5).select("id", F.lit(0).cast("bigint").alias("v"), F.lit(9).alias("seq")).write.parquet(f"{table}/data/_c=2-lost")
    assert FT.read(spark, table).count() == 10_000 and FT.newest(spark, table) == 1


def test_versions_and_vacuum(spark, table):
    for i in (1, 2, 3):
        rows = spark.range(100 * i, 100 * i + 10).select("id", F.lit(-i).cast("bigint").alias("v"), F.lit(i).alias("seq"))
        FT.merge(table, rows, "id", ["seq"], later(i))
    for i in (1, 2, 3, 4):
        assert FT.read(spark, table, i).where("v < 0").count() == 10 * (i - 1)
    assert FT.vacuum(spark, table, 2, later(3), grace_hours=24 * 30)["deleted"] == 0
    done = FT.vacuum(spark, table, 2, later(30), grace_hours=24)
    assert done["kept_from"] == 3 and done["deleted"] > 0 and FT.readable_versions(spark, table) == [3, 4]
    assert FT.vacuum(spark, table, 2, later(30), grace_hours=24)["deleted"] == 0
    assert FT.read(spark, table, 3).where("v < 0").count() == 20 and FT.read(spark, table).where("v < 0").count() == 30
    with pytest.raises(ValueError):
        FT.read(spark, table, 9)


def test_z_order_prunes_by_every_column(spark):
    path = work_dir(spark, "z")
    df = spark.range(40_000).select(
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("a"), F.concat(F.lit("k"), F.lpad(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).cast("string"), 4, "0")).alias("b"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(365)).cast("int")).alias("c"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("d"))
    FT.z_order(df, path, ["a", "b", "c"], 64, AT)
    for column, low, high in (("a", 300, 310), ("b", "k0200", "k0205"), ("c", dt.date(2024, 6, 1), dt.date(2024, 6, 7))):
        got, files, total = FT.read_where(spark, path, column, low, high)
        assert got.count() == df.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))).count() and 3 * files <= total and 60 <= total <= 68
    assert FT.read(spark, path).count() == 40_000 and FT.read_where(spark, path, "a", high=-1)[0].count() == 0
    nulls = work_dir(spark, "z2")
    FT.z_order(df.select("d", F.lit(None).cast("string").alias("e")), nulls, ["d", "e"], 4, AT)
    assert FT.read(spark, nulls).count() == 40_000
