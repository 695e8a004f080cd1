"""File streams between layers, with checkpoints and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.operators.assess import rule_results
from dqflow.operators.expect import keep

MAX_FILES = 1000


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json", max_files: int = MAX_FILES, **options) -> DataFrame:
    """Incremental read of new files with lineage columns."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def with_lineage(df: DataFrame, source_id: str) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_source_file")).withColumns(
        {"_ingestion_timestamp": F.current_timestamp(), "_pipeline_id": F.lit(source_id)}
    )


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def append_to(df: DataFrame, target: str, checkpoint: str, interval: str | None = None):
    """Append a stream to a parquet layer; ``None`` processes what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target)
    return _trigger(writer, interval).start()


def for_each(df: DataFrame, handle, checkpoint: str, interval: str | None = None, mode: str = "append"):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return _trigger(writer, interval).start()


def layer_stream(spark: SparkSession, upstream: str, target: str, checkpoint: str, expectations, interval=None):
    """Stream one layer into the next, dropping rows its expectations reject."""
    schema = spark.read.parquet(upstream).schema
    stream = file_stream(spark, upstream, schema, "parquet")
    return append_to(keep(stream, expectations), target, checkpoint, interval)


def refresh(df_factory, target: str, checkpoint: str):
    """Full refresh: a new checkpoint and a target written from scratch."""
    return append_to(df_factory(), target, checkpoint)


def quality_checks(stream: DataFrame, rules, log: str, checkpoint: str, interval: str | None = None):
    """Assess every micro-batch and append its rule results to a log.

    A batch that is run again after a failure overwrites its own part of the
    log, named by the batch number.
    """

    def handle(batch: DataFrame, number: int):
        rule_results(batch, rules).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/part={number}")

    return for_each(stream, handle, checkpoint, interval)


def evolve_and_append(spark: SparkSession, path: str, target: str, checkpoint: str, registered, incoming, fmt="parquet"):
    """Restart a stream under the union of the registered and the incoming schema.

    Only additions are accepted; new columns are NULL in rows of older files.
    """
    from dqflow.sources.registry import diff, judge, schema_rows, widened

    verdict = judge(diff(schema_rows(spark, registered), schema_rows(spark, incoming))).first()
    if verdict["compatibility"] == "breaking":
        raise ValueError("breaking schema change")
    schema = widened(registered, incoming)
    return append_to(file_stream(spark, path, schema, fmt), target, checkpoint)


def unseen(batch: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Rows of a micro-batch whose key is not in the target yet, one per key."""
    from dqflow.operators.skew import first_per_key

    fresh = batch.join(target.select(*keys), list(keys), "left_anti")
    rest = [c for c in batch.columns if c not in keys]
    return first_per_key(fresh, list(keys), rest)


def classify_failure(message: str) -> str:
    """Coarse reason of a failed ingestion, for the failure log."""
    text = message.lower()
    for name, words in (("schema_drift", ("schema", "column")), ("missing_source", ("not found", "does not exist")),
                        ("permission", ("permission", "access denied"))):
        if any(w in text for w in words):
            return name
    return "unknown"


def live_totals(totals: DataFrame, target: str, checkpoint: str, interval: str | None = None):
    """Keep the changing rows of an aggregated stream in ``target``, once each.

    Every micro-batch writes the groups it changed as its own part, named by its number.  A batch that is run again
    after a failure between write and commit overwrites that part, so nothing counts twice.
    """
    def handle(batch: DataFrame, number: int):
        batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/part={number}")

    return for_each(totals, handle, checkpoint, interval, "update")


def read_live(spark: SparkSession, target: str, keys) -> DataFrame:
    """The newest row of each group."""
    rows = spark.read.parquet(target).drop("part")
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rest])


def dropped_rows(query) -> int:
    """Rows that a finished query's watermark dropped, summed over the progress of its micro-batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
