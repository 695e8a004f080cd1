"""Runs of several steps with a journal: a failed run goes on where it stopped, every step takes effect once.

A step writes its result below the run's folder and is done when the journal
says so; a step that failed halfway is simply written again.  The journal is an
append-only table of one row per attempt.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.streaming.ingest import classify_failure

ENTRY = "run_id string, step string, place int, status string, rows bigint, started_at timestamp, ended_at timestamp, reason string"


def entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRY).json(f"{path}/_journal")
    except AnalysisException:
        return spark.createDataFrame([], ENTRY)


def _note(spark, path, row) -> None:
    spark.createDataFrame([row], ENTRY).coalesce(1).write.mode("append").json(f"{path}/_journal")


def step_result(spark: SparkSession, path: str, run_id: str, step: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{run_id}/{step}")


def run_steps(spark: SparkSession, path: str, run_id: str, steps: list[tuple[str, Callable]], clock=None) -> DataFrame:
    """Run ``steps`` (name, function of the results so far) in order, leaving out those the journal has as done.

    A function gets a dict of the earlier steps' stored results and returns a DataFrame.  A failure is noted with
    its reason and raised; calling again with the same ``run_id`` resumes.  The result is the run's record.
    """
    clock = clock or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    done = {r["step"] for r in entries(spark, path).where((F.col("run_id") == run_id) & (F.col("status") == "SUCCESS")).select("step").collect()}
    results: dict[str, DataFrame] = {}
    for place, (name, work) in enumerate(steps):
        if name not in done:
            started = clock()
            try:
                work(results).write.mode("overwrite").parquet(f"{path}/{run_id}/{name}")
                rows = step_result(spark, path, run_id, name).count()
            except Exception as e:
                _note(spark, path, (run_id, name, place, "FAILED", None, started, clock(), classify_failure(str(e))))
                raise
            _note(spark, path, (run_id, name, place, "SUCCESS", rows, started, clock(), None))
        results[name] = step_result(spark, path, run_id, name)
    return run_record(spark, path, len(steps)).where(F.col("run_id") == run_id)


def run_record(spark: SparkSession, path: str, steps: int) -> DataFrame:
    """One row per run: status, steps done, attempts, failures, rows of the last step, first start and last end."""
    ok = F.col("status") == "SUCCESS"
    out = entries(spark, path).groupBy("run_id").agg(
        F.count_distinct(F.when(ok, F.col("step"))).alias("steps_done"), F.count(F.lit(1)).alias("attempts"), F.count_if(~ok).alias("failures"),
        F.max_by(F.when(ok, F.col("rows")), F.when(ok, F.col("place"))).alias("records"), F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"), F.max_by("status", "ended_at").alias("_last"))
    status = F.when(F.col("steps_done") == steps, "SUCCESS").when(F.col("_last") == "FAILED", "FAILED").otherwise("RUNNING")
    return out.withColumn("status", status).drop("_last")
