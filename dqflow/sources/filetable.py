"""Versioned tables of files: merge by touched file, clustered layout with statistics, time travel and clean-up.

A commit writes its new files first and then one log entry: the files it adds
(with the key range, row count and column ranges of each) and the files it
takes out of the table.  A version is the fold of the log up to it, so readers
see whole versions only, a failed commit leaves nothing visible, and old
versions stay readable until ``vacuum`` removes files that no kept version
needs.

One writer commits at a time: the log entry of a version can be created once.
"""

from __future__ import annotations

import json
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow.operators.skew import all_not_null, as_list
from dqflow.session import work_dir
from dqflow.sources.merge import latest_source
from dqflow.sources.registry import union_all, widened
from dqflow.sources.tables import stored_layer

#: Slices of the sorted incoming keys that are compared with the files' key ranges; as many rows are broadcast.
SLICES = 1000
RANGES = "map<string,struct<low:string,high:string>>"
LOG = f"version bigint, committed_at timestamp, operation string, file string, added boolean, rows bigint, ranges {RANGES}, schema_json string"


def _log(path: str) -> str:
    return f"{path}/_log"


def log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).option("basePath", _log(path)).json(f"{_log(path)}/v=*")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit: version, committed_at, operation, files added and removed."""
    return log(spark, path).groupBy("version", "committed_at", "operation").agg(
        F.count_if("added").alias("files_added"), F.count_if(F.col("added") == False).alias("files_removed"))  # noqa: E712


def newest(spark: SparkSession, path: str) -> int:
    return log(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """file, rows, ranges of the files that make up a version (the newest unless given)."""
    entries = log(spark, path).where("file IS NOT NULL")
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    last = entries.groupBy("file").agg(F.max_by(F.struct("added", "rows", "ranges"), F.struct("version", "added")).alias("e"))
    return last.where("e.added").select("file", "e.rows", "e.ranges")


def _paths(files: DataFrame) -> list[str]:
    """File names of a table's manifest: metadata, one row per file."""
    return [r["file"] for r in files.select("file").collect()]


def _read(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def table_schema(spark: SparkSession, path: str, version: int | None = None) -> T.StructType:
    """The columns as of a version, from the log."""
    entries = log(spark, path).where("schema_json IS NOT NULL")
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    row = entries.agg(F.max_by("schema_json", "version")).first()
    if row[0] is None:
        raise ValueError(f"no table at {path}")
    return T.StructType.fromJson(json.loads(row[0]))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version."""
    if version is not None and not versions(spark, path).where(F.col("version") == version).count():
        raise ValueError(f"no version {version}")
    return _read(spark, _paths(live_files(spark, path, version)), table_schema(spark, path, version))


def _as_text(c: Column, kind: T.DataType) -> Column:
    """Text whose order is that of the values, for ranges in the log: numbers shifted to be positive and padded."""
    if isinstance(kind, T.IntegralType):
        return F.lpad((c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.StringType):
        return c
    raise TypeError(f"no ordered text for {kind.simpleString()}")


def _store(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, operation: str, new: DataFrame | None, removed: DataFrame | None, indexed, at, max_rows: int = 0) -> int:
    """Write ``new`` as files, then log them and the ``removed`` ones (column file) as the next version.

    Ranges of the ``indexed`` columns are taken from the written files, one row per file.
    """
    version = newest(spark, path) + 1
    entries = []
    if new is not None:
        place = work_dir(spark, "x").rsplit("-", 1)[1]
        target = f"{path}/data/_c={version}-{place}"
        new.write.mode("errorifexists").option("maxRecordsPerFile", max_rows).parquet(target)
        kinds = {f.name: f.dataType for f in new.schema.fields}
        written = spark.read.schema(new.schema).parquet(target)
        bounds = [F.struct(F.min(_as_text(F.col(c), kinds[c])).alias("low"), F.max(_as_text(F.col(c), kinds[c])).alias("high")) for c in indexed]
        ranges = F.create_map(*[x for c, b in zip(indexed, bounds) for x in (F.lit(c), b)]).cast(RANGES)
        entries.append(written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), ranges.alias("ranges")).withColumn("added", F.lit(True)))
    if removed is not None:
        entries.append(removed.select("file", F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast(RANGES).alias("ranges"), F.lit(False).alias("added")))
    # One row of each commit names no file: it holds the columns, and makes a commit without files count.
    columns = new.schema if version == 1 else table_schema(spark, path) if new is None else widened(table_schema(spark, path), new.schema)
    entries.append(spark.range(1).select(
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast(RANGES).alias("ranges"), F.lit(None).cast("boolean").alias("added"),
        F.lit(columns.json()).alias("schema_json")))
    rows = union_all(entries)
    rows.select(F.lit(version).cast("bigint").alias("version"), F.lit(at).cast("timestamp").alias("committed_at"), F.lit(operation).alias("operation"),
                "file", "added", "rows", "ranges", "schema_json").coalesce(1).write.mode("errorifexists").json(f"{_log(path)}/v={version}")
    return version


def create(df: DataFrame, path: str, keys, at, files: int) -> int:
    """A table clustered by its keys, so that each file holds a range of them."""
    keys = as_list(keys)
    return commit(df.sparkSession, path, "create", df.repartitionByRange(files, *keys).sortWithinPartitions(*keys), None, keys, at)


def overlapping(files: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Files whose key range meets a slice of the source's keys.

    The source's keys are sorted into at most ``SLICES`` slices, each known by its smallest and largest key, so a file
    between two clusters of keys is not touched; only the slices are broadcast.
    """
    kind = source.schema[key].dataType
    text = source.where(F.col(key).isNotNull()).select(_as_text(F.col(key), kind).alias("k"))
    cut = text.repartitionByRange(SLICES, "k").groupBy(F.spark_partition_id().alias("s")).agg(F.min("k").alias("low"), F.max("k").alias("high"))
    return files.join(F.broadcast(cut.drop("s")), (F.col("ranges")[key]["low"] <= F.col("high")) & (F.col("ranges")[key]["high"] >= F.col("low")), "left_semi")


def touched_files(spark: SparkSession, path: str, source: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(candidates, touched): files whose range may hold a source key, and those that do hold one.

    Candidates come from the log alone; of these only the key columns are read.
    """
    keys = as_list(keys)
    candidates = stored_layer(overlapping(live_files(spark, path), source, keys[0]).select("file"), "candidates")
    names = _paths(candidates)
    held = _read(spark, names, table_schema(spark, path)).select(*keys, F.col("_metadata.file_path").alias("file")) if names else None
    if held is None:
        return candidates, candidates
    hit = held.join(source.select(*keys).where(all_not_null(keys)).distinct(), keys, "left_semi").select("file").distinct()
    return candidates, stored_layer(hit, "touched")


def merge(path: str, source: DataFrame, keys, order: list, at) -> dict:
    """Upsert that rewrites only the files holding a key of the source; what it read and rewrote.

    Of equal source keys the last by ``order`` counts.  Rows that bring nothing newer than the table's own row (by
    ``order``, which the table must hold) change nothing, so merging the same rows again commits no file.
    New keys become files of their own, clustered like the rest.
    """
    spark, keys = source.sparkSession, as_list(keys)
    files, schema = live_files(spark, path), table_schema(spark, path)
    new = stored_layer(latest_source(source, keys, order), "source")
    candidates, touched = touched_files(spark, path, new, keys)
    names = _paths(touched)
    old = _read(spark, names, schema).withColumn("_file", F.col("_metadata.file_path")) if names else None
    fresh = new
    if old is not None:
        stale = old.select(*keys, F.struct(*order).alias("_had")).join(new.select(*keys, F.struct(*order).alias("_has")), keys).where("_had >= _has").select(*keys)
        fresh = stored_layer(new.join(stale, keys, "left_anti"), "fresh")
        rewritten = stored_layer(old.select(*keys, "_file").join(fresh.select(*keys), keys, "left_semi").select(F.col("_file").alias("file")).distinct(), "rewritten")
        names = _paths(rewritten)
    total = files.count()
    out = {"files": total, "candidates": candidates.count(), "rewritten": len(names)}
    if fresh.isEmpty():
        return out | {"version": newest(spark, path), "added": 0}
    kept = _read(spark, names, schema).join(fresh.select(*keys).where(all_not_null(keys)), keys, "left_anti")
    rows = kept.unionByName(fresh, allowMissingColumns=True)
    layout = rows.repartitionByRange(max(1, len(names)), *keys).sortWithinPartitions(*keys)
    removed = spark.createDataFrame([(n,) for n in names], "file string")
    version = commit(spark, path, "merge", layout, removed, keys, at)
    added = versions(spark, path).where(F.col("version") == version).first()["files_added"]
    return out | {"version": version, "added": added}


# -- clustered layout ------------------------------------------------------

BITS = 8


def cut_points(df: DataFrame, columns) -> dict[str, list]:
    """About 2^BITS - 1 values per column that cut its rows evenly: a sketch decides where, never what is found."""
    shares = [(i + 1) / 2**BITS for i in range(2**BITS - 1)]
    out = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            # Strings are cut at hashed sample values: at most 2^BITS * 16 of them are looked at.
            some = df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(F.xxhash64(c)).limit(2**BITS * 16).select(c).collect()
            values = sorted(r[0] for r in some)
            out[c] = sorted({values[int(s * (len(values) - 1))] for s in shares}) if values else []
        else:
            number = F.unix_date(c) if isinstance(kind, T.DateType) else F.col(c).cast("double")
            found = df.agg(F.percentile_approx(number.cast("double"), shares, 10_000)).first()[0]
            out[c] = sorted(set(found or []))
    return out


def _further(cuts: Column, value: Column):
    return lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at)


def morton(df: DataFrame, columns) -> Column:
    """Interleaved bits of the columns' ranks among their cut points; NULL ranks first."""
    points = cut_points(df, columns)
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        value = F.col(c) if isinstance(kind, T.StringType) else (F.unix_date(c) if isinstance(kind, T.DateType) else F.col(c)).cast("double")
        # The number of cut points up to the value, by halving.
        strides, cuts = F.array(*[F.lit(2**b) for b in reversed(range(BITS))]), F.array(*[F.lit(v) for v in points[c]])
        rank = F.aggregate(strides, F.lit(0), _further(cuts, value)) if points[c] else F.lit(0)
        # Few distinct values have few cut points: their ranks are spread over all bits, and each rank's bits over the curve's.
        spread = [math.floor(r * ((2**BITS - 1) / max(1, len(points[c])))) for r in range(len(points[c]) + 1)]
        placed = F.array(*[F.lit(sum(((r >> b) & 1) << (b * len(columns) + i) for b in range(BITS))).cast("bigint") for r in spread])
        out = out.bitwiseOR(F.when(value.isNull(), F.lit(0).cast("bigint")).otherwise(F.get(placed, rank)))
    return out


def z_order(df: DataFrame, path: str, columns, files: int, at) -> int:
    """Write a table along the Z-curve of several columns and log each file's range of every one of them.

    The leading bits of the curve cut the table into about ``files`` cells, boxes that are equally wide in every column's
    ranks, and each cell becomes a file.  Cells that correlated columns fill above three times the average are
    split along the curve.
    """
    bits = min(BITS * len(columns), max(0, math.ceil(math.log2(files))))
    cell = F.shiftright("_z", BITS * len(columns) - bits)
    rows = stored_layer(df, "z-rows")  # read for the cut points of every column, the ranges and the cells
    rows = rows.withColumn("_z", morton(rows, columns))
    # More ranges than cells: every cell is a range of its own.
    ordered = rows.repartitionByRange(4 * 2**bits, cell).sortWithinPartitions("_z").drop("_z")
    return commit(df.sparkSession, path, "z_order", ordered, None, list(columns), at, max_rows=max(1, 3 * rows.count() // 2**bits))


def read_where(spark: SparkSession, path: str, column: str, low=None, high=None, version: int | None = None) -> tuple[DataFrame, int, int]:
    """Rows with ``low <= column <= high``, reading only files whose range meets that; files read and files in all."""
    schema, files = table_schema(spark, path), live_files(spark, path, version)
    kind, keep, rows = schema[column].dataType, F.lit(True), F.lit(True)
    if low is not None:
        keep, rows = keep & (F.col("ranges")[column]["high"] >= _as_text(F.lit(low).cast(kind), kind)), rows & (F.col(column) >= F.lit(low).cast(kind))
    if high is not None:
        keep, rows = keep & (F.col("ranges")[column]["low"] <= _as_text(F.lit(high).cast(kind), kind)), rows & (F.col(column) <= F.lit(high).cast(kind))
    names = _paths(files.where(keep))
    return _read(spark, names, schema).where(rows), len(names), files.count()


# -- clean-up --------------------------------------------------------------

def vacuum(spark: SparkSession, path: str, keep_versions: int, at, grace_hours: float = 168.0) -> dict:
    """Delete files that none of the newest ``keep_versions`` versions needs, and drop the older versions from the log's reach.

    A file goes only when it left the table at least ``grace_hours`` before ``at``: whoever reads an older version
    started before that.  Files of commits that never reached the log go under the same rule, by their age.  Running it
    again deletes nothing more.
    """
    entries = log(spark, path)
    top = newest(spark, path)
    kept_from = max(1, top - keep_versions + 1)
    out_at = entries.where("NOT added").groupBy("file").agg(F.max("version").alias("gone"), F.max("committed_at").alias("since"))
    limit = F.lit(at).cast("timestamp") - F.make_dt_interval(secs=F.lit(math.floor(grace_hours * 3600)).cast("decimal(18,6)"))
    dead = _paths(out_at.where((F.col("gone") <= kept_from) & (F.col("since") <= limit)))
    gone = 0
    for name in dead:
        file, store = _store(spark, name)
        gone += bool(store.delete(file, False))
    return {"kept_from": kept_from, "deleted": gone}


def readable_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions all of whose files are still there."""
    found = set(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/data").select(
        F.regexp_replace("path", "^file:/+", "/")).toPandas().iloc[:, 0])
    out = []
    for v in [r["version"] for r in versions(spark, path).select("version").orderBy("version").collect()]:
        files = live_files(spark, path, v).select(F.regexp_replace("file", "^file:/+", "/").alias("file"))
        if all(r["file"] in found for r in files.collect()):
            out.append(v)
    return out
