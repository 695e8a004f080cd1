"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app="dqflow", master=None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_ROOTS: dict[str, str] = {}


def _session_root(spark: SparkSession) -> str:
    """One folder per application below the shared checkpoint folder, deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            root = tempfile.mkdtemp(prefix="dqflow-")
        path = f"{root.rstrip('/')}/dqflow-{app}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
        _ROOTS[app] = path
    return _ROOTS[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only a local master, whose
    driver and tasks share one disk, may fall back to a temporary folder.
    """
    return f"{_session_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
