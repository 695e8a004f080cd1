"""Upserts, merge-on-read schemas, snapshots, retention and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.operators.skew import all_not_null, as_list, last_per_key


def latest_source(source: DataFrame, keys, order: list) -> DataFrame:
    """One row per key, the latest; rows with a NULL key match nothing and all stay."""
    whole = all_not_null(keys)
    return last_per_key(source.where(whole), keys, order).unionByName(source.where(~whole))


def upsert(target: DataFrame, source: DataFrame, keys, order: list) -> DataFrame:
    """Target with matching rows replaced and new rows added, columns united."""
    keys = as_list(keys)
    new = latest_source(source, keys, order)
    kept = target.join(new.select(*keys).where(all_not_null(keys)), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _log(path: str) -> str:
    return f"{path}/_versions"


def current_version(spark: SparkSession, path: str) -> str | None:
    """Name of the last published version, read from a one-row-per-version log."""
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.schema("version string").json(_log(path))
    except AnalysisException:
        return None
    return log.agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/data/{version}")


def publish(df: DataFrame, path: str, version: str) -> None:
    """Write a full version, then log it; readers see it only once it is whole."""
    df.write.mode("errorifexists").parquet(f"{path}/data/{version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").json(_log(path))


def merge_into(path: str, source: DataFrame, keys, order: list, version: str) -> DataFrame:
    """Upsert into a versioned table, creating it on first use.

    ``version`` names must increase; the same version is never written twice.
    """
    spark = source.sparkSession
    target = read_current(spark, path)
    merged = latest_source(source, as_list(keys), order) if target is None else upsert(target, source, keys, order)
    publish(merged, path, version)
    return read_current(spark, path)


def publish_partitions(df: DataFrame, path: str, version: str, partition: str, touched: DataFrame) -> None:
    """Write new contents of the ``touched`` partitions, then log them.

    The log names the version each partition is read from.  It is appended
    last, so a failed write leaves the table as it was, and a partition that
    became empty is simply logged without files.
    """
    df.write.mode("errorifexists").partitionBy(partition).parquet(f"{path}/data/_v=v{version}")
    touched.select(F.col(partition).cast("string").alias("part"), F.lit(f"v{version}").alias("_v")).write.mode("append").parquet(
        f"{path}/_partitions"
    )


def create_partitions(df: DataFrame, path: str, version: str, partition: str) -> None:
    publish_partitions(df, path, version, partition, df.select(partition).distinct())


def read_partitions(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Current contents; the join on the small log prunes replaced versions' files."""
    live = spark.read.parquet(f"{path}/_partitions").groupBy("part").agg(F.max("_v").alias("_v"))
    data = spark.read.parquet(f"{path}/data")
    return data.join(live, (data["_v"] == live["_v"]) & (data[partition].cast("string") == live["part"]), "left_semi").drop("_v")


def merge_partitions(path: str, source: DataFrame, keys, order: list, partition: str, version: str) -> DataFrame:
    """Upsert a partitioned table, rewriting only partitions that change.

    Those are the partitions of the incoming rows and the ones their old
    versions live in.
    """
    keys = as_list(keys)
    spark = source.sparkSession
    target = read_partitions(spark, path, partition)
    new = latest_source(source, keys, order)
    old_homes = target.join(new.select(*keys).where(all_not_null(keys)), keys, "left_semi").select(partition)
    touched = new.select(partition).unionByName(old_homes).distinct()
    part = target.join(touched, partition, "left_semi")
    publish_partitions(upsert(part, source, keys, order).select(*target.columns), path, version, partition, touched)
    return read_partitions(spark, path, partition)


def snapshot(df: DataFrame, path: str, at) -> str:
    """Copy of a table under a name that carries the time."""
    name = f"{path}_v{at:%Y%m%d_%H%M%S}"
    df.write.mode("errorifexists").parquet(name)
    return name


# Days to keep per data class.
RETENTION_DAYS = {"raw": 2555, "processed": 3650, "audit": 2190, "metrics": 30, "usage_events": 90, "dashboard": 90}


def retained(df: DataFrame, ts: str, kind: str, as_of, days: int | None = None) -> DataFrame:
    keep = RETENTION_DAYS[kind] if days is None else days
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(keep)))


#: Rows that one range of a compacted table should hold at most.
RANGE_ROWS = 1_000_000


def compact(df: DataFrame, path: str, cluster_by, partitions: int, partition_by=()) -> None:
    """Rewrite a table range-clustered and sorted, so row groups can be skipped.

    ``partitions`` is the least number of ranges: it grows with the rows, so a task's share does not.  Rows alike in all
    cluster columns are cut by a hash of the row, so a frequent value spreads over several ranges too.
    """
    partitions = max(partitions, -(-df.count() // RANGE_ROWS))
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    out = df.repartitionByRange(partitions, *partition_by, *cluster_by, F.xxhash64(*plain)).sortWithinPartitions(*partition_by, *cluster_by)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_log(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append rows to an operational log, partitioned by day."""
    df.withColumn("event_date", F.to_date(ts)).write.mode("append").partitionBy("event_date").parquet(path)


def latest_by(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest logged row per key; keys without rows are simply absent."""
    return last_per_key(df, key, [ts])
