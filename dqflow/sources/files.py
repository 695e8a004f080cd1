"""Batch file sources, lineage columns, exports and source configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("json", "csv", "parquet")


def read_batch(spark: SparkSession, path, fmt: str = "json", schema=None) -> DataFrame:
    """JSON, CSV with header or parquet; malformed text lands in ``_corrupt_record``.

    A given schema skips the inference pass over the files.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if fmt in ("json", "csv"):
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if fmt == "parquet":
        reader = reader.option("mergeSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    return reader.load(path)


def with_lineage(df: DataFrame, source_id: str, at=None) -> DataFrame:
    """Ingestion time, source file and source id."""
    stamp = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return df.select("*", F.col("_metadata.file_path").alias("_source_file")).withColumns(
        {"_ingestion_timestamp": stamp, "_pipeline_id": F.lit(source_id)}
    )


def union_feeds(frames: dict, label: str = "state") -> DataFrame:
    """Feeds with partly different columns as one, labelled by their name."""
    parts = [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_states(spark: SparkSession, paths: dict, fmt: str, schema=None) -> DataFrame:
    return union_feeds({s: read_batch(spark, p, fmt, schema) for s, p in paths.items()})


EXPORTS = ("json", "csv", "parquet")


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a result table; nested columns become JSON text in CSV."""
    if fmt not in EXPORTS:
        raise ValueError(f"unsupported export format {fmt!r}")
    if fmt == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def export_document(document: dict, fmt: str = "json") -> str:
    """An assessment document (rule-sized) as JSON or YAML text."""
    if fmt == "json":
        return json.dumps(document, indent=2, default=str)
    if fmt == "yaml":
        import yaml

        return yaml.safe_dump(json.loads(json.dumps(document, default=str)), sort_keys=False)
    raise ValueError(f"unsupported export format {fmt!r}")


@dataclass(frozen=True)
class SourceSpec:
    """One configured feed and its quality limits."""

    name: str
    source_path: str
    target_table: str
    schedule: str = "manual"
    file_format: str = "json"
    min_quality: float = 0.8
    max_anomaly_percentage: float = 5.0
    max_stale_percentage: float = 10.0


def load_specs(config: dict) -> list[SourceSpec]:
    known = set(SourceSpec.__dataclass_fields__) - {"name"}
    return [SourceSpec(name=n, **{k: v for k, v in c.items() if k in known}) for n, c in config.items()]


def limits_row(spec: SourceSpec) -> dict:
    return {
        "min_quality_score": spec.min_quality,
        "max_anomaly_percentage": spec.max_anomaly_percentage,
        "max_stale_percentage": spec.max_stale_percentage,
    }
