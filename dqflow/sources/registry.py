"""Schema versions, schema comparison and drift reactions.

A schema is handled as rows ``(path, type, nullable)``.  Table schemas are
flattened from their ``StructType``; feeds of JSON documents get theirs from
the documents themselves, by a Spark job.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow.sources.tables import stored_layer

FIELDS = "path string, type string, nullable boolean"
CHANGES = ("field_added", "field_removed", "data_type_changed", "nullability_changed")


def flatten(schema: T.StructType, prefix: str = "") -> list[tuple]:
    """(path, type, nullable) of every field at any depth: ``a.b`` in structs, ``a[]`` in arrays, ``a{}`` in maps' values."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        out.append((path, "struct" if isinstance(kind, T.StructType) else kind.simpleString(), f.nullable))
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind, path = (kind.elementType, path + "[]") if isinstance(kind, T.ArrayType) else (kind.valueType, path + "{}")
        if isinstance(kind, T.StructType):
            out += flatten(kind, path + ".")
    return out


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(flatten(schema), FIELDS)


def observed_schema(docs: DataFrame, text: str, by=()) -> DataFrame:
    """Fields seen in JSON documents: path, narrowest type, nullable.

    One row per field and batch comes out of the aggregation, whatever the
    number of documents.
    """
    by = list(by)
    totals = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("_docs"))
    pairs = docs.select(*by, F.explode(F.from_json(F.col(text), "map<string,string>")).alias("path", "value"))
    v = F.col("value")
    seen = pairs.groupBy(*by, "path").agg(
        F.count(v).alias("n"),
        F.count_if(v.rlike(r"^-?[0-9]+$")).alias("i"),
        F.count_if(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")).alias("d"),
        F.count_if(v.isin("true", "false")).alias("b"),
    )
    n = F.col("n")
    kind = (
        F.when(n == 0, F.lit("void")).when(F.col("i") == n, F.lit("bigint")).when(F.col("d") == n, F.lit("double"))
        .when(F.col("b") == n, F.lit("boolean")).otherwise(F.lit("string"))
    )
    joined = seen.join(totals, by) if by else seen.withColumn("_docs", totals.scalar())
    return joined.select(*by, "path", kind.alias("type"), (n < F.col("_docs")).alias("nullable"))


def observed_fields(docs: DataFrame, text: str, by=(), maps=(), depth: int = 32) -> DataFrame:
    """Fields at every depth of JSON documents: path, type, nullable.

    Objects give ``a.b``, arrays ``a[]`` and objects named in ``maps`` (paths whose keys are data) ``a{}``.  Types are
    those of the JSON values (a quoted number is a string); whole and fractional numbers together are double, other
    mixtures string.  A field is nullable when it is null in, or missing from, any object that could hold it.

    One pass per level of nesting: a level's objects and arrays are unfolded once, and what travels is one row per
    path and type, whatever the number of documents.  Texts that are no JSON have no fields.
    """
    by = list(by)
    found = []
    level = docs.select(*by, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    for _ in range(depth + 1):
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        level = stored_layer(level.withColumn("kind", kind).select(*by, "path", "kind", F.to_json("v").alias("j")), "fields")
        counts = stored_layer(level.groupBy(*by, "path", "kind").agg(F.count(F.lit(1)).alias("n")), "kinds")
        found.append(counts)
        nested = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if len(found) > depth or counts.where(F.col("kind").isin("OBJECT", "ARRAY")).isEmpty():
            break
        inner = nested.lateralJoin(docs.sparkSession.tvf.variant_explode(F.parse_json(F.col("j").outer())))
        key = F.when(F.col("kind") == "ARRAY", F.concat("path", F.lit("[]"))).when(
            F.col("path").isin(*maps) if maps else F.lit(False), F.concat("path", F.lit("{}"))).when(
            F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        level = inner.select(*by, key.alias("path"), F.col("value").alias("v"))
    kinds = reduce(DataFrame.unionByName, found)
    of = {"BIGINT": "bigint", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean",
          "OBJECT": "struct", "ARRAY": "array", "VOID": "void"}
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("kind")], F.lit("string"))
    rows = kinds.withColumn("type", named).groupBy(*by, "path").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("type") == "void", F.col("n")).otherwise(0)).alias("nulls"),
        F.array_sort(F.collect_set(F.when(F.col("type") != "void", F.col("type")))).alias("types"))
    type_ = F.when(F.size("types") == 0, "void").when(F.size("types") == 1, F.col("types")[0]).when(
        F.col("types") == F.array(F.lit("bigint"), F.lit("double")), "double").otherwise("string")
    # The objects that could hold a field: those of the path before its last name.
    parent = F.regexp_replace("path", r"(^|\.)[^.]*$", "")
    holders = kinds.where("kind = 'OBJECT'").select(*by, F.col("path").alias("_in"), F.col("n").alias("_objects"))
    out = rows.where("path <> ''").withColumn("_in", parent).join(holders, [*by, "_in"], "left")
    unfolded = F.col("path").endswith("[]") | F.col("path").endswith("{}")
    missing = ~unfolded & (F.col("n") < F.coalesce("_objects", F.lit(0)))
    return out.select(*by, "path", type_.alias("type"), (missing | (F.col("nulls") > 0)).alias("nullable"))


def diff(old: DataFrame, new: DataFrame, by=()) -> DataFrame:
    """Changes from ``old`` to ``new``; a type change hides a nullability change."""
    keys = [*by, "path"]
    o = old.select(*keys, F.col("type").alias("old_type"), F.col("nullable").alias("old_null"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col("type").alias("new_type"), F.col("nullable").alias("new_null"), F.lit(True).alias("_n"))
    change = (
        F.when(F.col("_o").isNull(), F.lit("field_added"))
        .when(F.col("_n").isNull(), F.lit("field_removed"))
        .when(F.col("old_type") != F.col("new_type"), F.lit("data_type_changed"))
        .when(F.col("old_null") != F.col("new_null"), F.lit("nullability_changed"))
    )
    return o.join(n, keys, "full_outer").select(
        *keys, change.alias("change"), "old_type", "new_type", "old_null", "new_null"
    ).where("change IS NOT NULL")


def has(change: str) -> Column:
    return F.coalesce(F.bool_or(F.col("change") == change), F.lit(False))


def judge(changes: DataFrame, by=()) -> DataFrame:
    """Compatibility and change class of a set of changes, one row per group.

    Without grouping columns an empty set of changes is fully compatible.
    """
    added, removed, retyped, nulls = (has(c) for c in CHANGES)
    out = changes.groupBy(*by).agg(
        added.alias("a"), removed.alias("r"), retyped.alias("t"), nulls.alias("n"), F.count(F.lit(1)).alias("changes")
    )
    a, r, t, n = (F.col(c) for c in "artn")
    return out.select(
        *by, "changes",
        F.when(r | t, F.lit("breaking")).when(a, F.lit("forward")).when(n, F.lit("backward")).otherwise(F.lit("full")).alias("compatibility"),
        F.when(t, F.lit("major_change")).when(r, F.lit("field_removal")).when(a, F.lit("field_addition"))
        .otherwise(F.lit("minor_change")).alias("change_type"),
    )


# -- registry --------------------------------------------------------------

def with_active(registry: DataFrame) -> DataFrame:
    """The newest version of each table is the active one; nothing is updated in place."""
    newest = F.max("version").over(W.partitionBy("table_name"))
    return registry.withColumn("is_active", F.col("version") == newest)


def active_schema(registry: DataFrame, table: str) -> T.StructType | None:
    row = registry.where(F.col("table_name") == table).agg(F.max_by("schema_json", "version").alias("s")).first()
    return None if row is None or row["s"] is None else T.StructType.fromJson(json.loads(row["s"]))


def new_version(registry: DataFrame, table: str, schema: T.StructType, changes: list, at, author: str) -> DataFrame:
    """The row to append for the next version of a table."""
    spark = registry.sparkSession
    top = registry.where(F.col("table_name") == table).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).scalar()
    return spark.range(1).select(
        F.lit(table).alias("table_name"), (top + 1).cast("int").alias("version"), F.lit(schema.json()).alias("schema_json"),
        F.lit(json.dumps(changes, default=str)).alias("changes"), F.lit(at).cast("timestamp").alias("registered_at"),
        F.lit(author).alias("registered_by"),
    )


def detect(spark: SparkSession, registry: DataFrame, table: str, schema: T.StructType, at, author="dqflow"):
    """``(event, row to register or None)`` for a table's incoming schema.

    First sight registers; equal schemas do nothing; additions and a mere
    nullability change register a version; removals and type changes do not.
    """
    known = active_schema(registry, table)
    if known is None:
        return {"status": "initial_registration", "compatibility": "full", "changes": []}, new_version(registry, table, schema, [], at, author)
    changes = diff(schema_rows(spark, known), schema_rows(spark, schema))
    listed = [r.asDict() for r in changes.orderBy("path").collect()]
    if not listed:
        return {"status": "no_change", "compatibility": "full", "changes": []}, None
    verdict = judge(changes).first()
    event = {"status": verdict["change_type"], "compatibility": verdict["compatibility"], "changes": listed}
    if verdict["compatibility"] == "breaking":
        return event, None
    return event, new_version(registry, table, widened(known, schema), listed, at, author)


def widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """Union of both schemas; a field nullable in either is nullable."""
    was = {f.name: f for f in old.fields}
    out = [
        T.StructField(f.name, f.dataType, f.nullable or f.name not in was or was[f.name].nullable) for f in new.fields
    ]
    out += [f for f in old.fields if f.name not in {g.name for g in new.fields}]
    return T.StructType(out)


REACTIONS = ("quarantine", "fail", "ignore", "snapshot")


def react(batch: DataFrame, target_path: str, event: dict, breaking: str = "quarantine", at=None) -> str:
    """Where a batch went: appended, quarantined, ignored; ``fail`` raises.

    ``snapshot`` keeps a copy of the target and quarantines the batch; only ``ignore`` drops one.
    """
    from dqflow.sources.merge import snapshot

    if breaking not in REACTIONS:
        raise ValueError(f"unknown reaction {breaking!r}")
    if event["compatibility"] != "breaking":
        batch.write.mode("append").parquet(target_path)
        return "appended"
    if breaking == "fail":
        raise ValueError(f"breaking schema change: {event['status']}")
    if breaking == "quarantine":
        batch.write.mode("append").parquet(f"{target_path}_quarantine")
        return "quarantined"
    if breaking == "snapshot":
        snapshot(batch.sparkSession.read.parquet(target_path), target_path, at)
        batch.write.mode("append").parquet(f"{target_path}_quarantine")
        return "snapshot"
    return "ignored"


def drift_metrics(log: DataFrame, since) -> DataFrame:
    return log.where(F.col("at") >= F.lit(since)).groupBy("compatibility").agg(F.count(F.lit(1)).alias("events"))


def day_over_day(docs: DataFrame, text: str, day: str) -> DataFrame:
    """Compatibility of each day's observed schema with the day before.

    Works on one row per day and field.
    """
    fields = observed_schema(docs, text, [day])
    before = fields.withColumn(day, F.date_add(day, 1))
    days = fields.select(day).distinct()
    both = before.join(days, day, "left_semi"), fields.join(before.select(day).distinct(), day, "left_semi")
    verdict = judge(diff(*both, [day]), [day])
    pairs = days.join(before.select(day).distinct(), day, "left_semi")
    return pairs.join(verdict, day, "left").select(
        F.col(day).alias("at"), F.coalesce("compatibility", F.lit("full")).alias("compatibility"),
        F.coalesce("change_type", F.lit("no_change")).alias("change_type"),
    )


def compare_tables(left: DataFrame, right: DataFrame, names=("left", "right")) -> DataFrame:
    """Cross-table compatibility row for the log."""
    spark = left.sparkSession
    changes = diff(schema_rows(spark, left.schema), schema_rows(spark, right.schema))
    issues = changes.agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "change")))).alias("issues")).scalar()
    return judge(changes).select(
        F.lit(names[0]).alias("source_table"), F.lit(names[1]).alias("target_table"), F.col("compatibility").alias("compatibility_level"),
        issues.alias("issues"), (F.col("compatibility") == "breaking").alias("resolution_required"),
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
