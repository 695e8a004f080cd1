"""Layers, typed operational tables and stored intermediate layers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from dqflow.session import work_dir

LAYERS = ("raw", "bronze", "silver", "gold", "monitoring", "schema_registry")


# Columns of the operational tables, as DDL text.
OPERATIONAL = {
    "pipeline_metrics": (
        "pipeline_id string, timestamp timestamp, total_records bigint, success_count bigint, failure_count bigint, "
        "processing_time_seconds double, throughput_records_per_second double, error_details string"
    ),
    "data_quality_metrics": (
        "table_name string, timestamp timestamp, total_records bigint, quality_score double, completeness_score double, "
        "validity_score double, anomaly_score double, quality_details string"
    ),
    "schema_drift_events": (
        "table_name string, timestamp timestamp, drift_type string, changes string, compatibility string, auto_resolved boolean"
    ),
    "job_events": (
        "job_name string, run_id string, event_type string, timestamp timestamp, duration_seconds double, "
        "error_message string, retry_count int"
    ),
    "quality_alerts": (
        "alert_id string, table_name string, alert_type string, severity string, timestamp timestamp, message string, "
        "resolved boolean, resolved_at timestamp"
    ),
    "table_schemas": (
        "table_name string, version int, schema_json string, changes string, registered_at timestamp, "
        "registered_by string, is_active boolean, compatibility_mode string"
    ),
    "schema_compatibility": (
        "source_table string, target_table string, compatibility_level string, checked_at timestamp, issues string, "
        "resolution_required boolean"
    ),
}
REGISTRY_TABLES = ("table_schemas", "schema_compatibility")


def layer_of(table: str) -> str:
    return "schema_registry" if table in REGISTRY_TABLES else "monitoring"


def create_layers(spark: SparkSession, prefix: str = "") -> list[str]:
    """One database per layer and the operational tables; safe to repeat."""
    made = []
    for layer in LAYERS:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {prefix}{layer}")
        made.append(f"{prefix}{layer}")
    for name, columns in OPERATIONAL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{layer_of(name)}.{name} ({columns}) USING parquet")
        made.append(f"{prefix}{layer_of(name)}.{name}")
    return made


def resolve(spark: SparkSession, name: str) -> DataFrame:
    """A path is read as parquet, anything else is a catalog table."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def stored_layer(df: DataFrame, name: str) -> DataFrame:
    """Write a layer below the shared work folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing
    the layers below, and later steps can use the stored statistics.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHARED: dict[tuple, DataFrame] = {}


def files_under(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of change of every file of a folder: what tells one state of it from another."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, listed = [], path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def shared_layer(spark: SparkSession, name: str, folder: str, build) -> DataFrame:
    """The layer of this name over ``folder``, written by its first reader in an application and read by all others.

    The key holds the state of the folder's files and the session's time zone, so new files or a session that reads
    times otherwise get a layer of their own.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    key = (spark.sparkContext.applicationId, name, zone, files_under(spark, folder))
    if key not in _SHARED:
        _SHARED[key] = stored_layer(build(), re.sub(r"[^A-Za-z0-9]+", "-", name))
    return _SHARED[key]
