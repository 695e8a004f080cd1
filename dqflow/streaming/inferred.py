"""File streams without a given schema: inferred once, stored, and evolved through the registry.

Nothing a document holds is lost: what the schema does not take is kept, as
text, in the ``_rescued`` column.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow.sources import registry
from dqflow.streaming.ingest import MAX_FILES, file_stream, for_each

RESCUED = "_rescued"
CORRUPT = "_corrupt"
REGISTRY = "table_name string, version int, schema_json string, changes string, registered_at timestamp, registered_by string"


# -- inferred once ---------------------------------------------------------

def infer(spark: SparkSession, path: str, fmt: str) -> T.StructType:
    """Schema of the files present, from one pass over them."""
    if fmt == "json":
        return spark.read.json(path).schema
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path).schema
    raise ValueError(f"no schema inference for {fmt!r}")


def stored_schema(spark: SparkSession, path: str, fmt: str, location: str) -> T.StructType:
    """The schema kept at ``location``; inferred and written there by the first call only."""
    try:
        return T.StructType.fromJson(json.loads(spark.read.text(location, wholetext=True).first()[0]))
    except AnalysisException:
        schema = infer(spark, path, fmt)
        spark.range(1).select(F.lit(schema.json()).alias("value")).coalesce(1).write.text(location)
        return schema


def _fits(raw: Column, kind: T.DataType) -> Column:
    """Whether a value's JSON text holds nothing that ``kind`` would lose: no misfit and no unknown field at any depth."""
    if isinstance(kind, T.StructType):
        own = F.from_json(raw, "map<string,string>")
        known = F.array(*[F.lit(n) for n in kind.names])
        inside = [F.forall(F.map_keys(own), lambda k: F.array_contains(known, k)), *[_fits(own[f.name], f.dataType) for f in kind.fields]]
        ok = own.isNotNull()
        for c in inside:
            ok = ok & c
        return raw.isNull() | F.coalesce(ok, F.lit(False))
    if isinstance(kind, T.MapType):
        own = F.from_json(raw, "map<string,string>")
        return raw.isNull() | F.coalesce(own.isNotNull() & F.forall(F.map_values(own), lambda v: _fits(v, kind.valueType)), F.lit(False))
    if isinstance(kind, T.ArrayType):
        own = F.from_json(raw, "array<string>")
        return raw.isNull() | F.coalesce(own.isNotNull() & F.forall(own, lambda v: _fits(v, kind.elementType)), F.lit(False))
    return raw.isNull() | isinstance(kind, T.StringType) | raw.try_cast(kind).isNotNull()


def _typed(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.when(_fits(raw, kind), F.from_json(raw, kind))
    return raw.try_cast(kind)


def typed_documents(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """JSON documents as columns of ``schema``; ``_rescued`` holds the rest.

    Rescued are fields the schema does not know, values that do not fit their type at some depth or hold inner fields it
    does not know (the column is NULL then), and the whole text of what is no JSON object, under ``_corrupt``.  NULL when nothing had to be rescued.
    """
    parsed = lines.withColumn("_raw", F.from_json(text, "map<string,string>"))
    fields = {f.name: _typed(F.col("_raw")[f.name], f.dataType) for f in schema.fields}
    unfit = [F.when(F.col("_raw")[f.name].isNotNull() & fields[f.name].isNull(), F.lit(f.name)) for f in schema.fields]
    bad = F.array_compact(F.array(*unfit))
    known = F.array(*[F.lit(n) for n in schema.names])
    rest = F.map_filter("_raw", lambda k, v: ~F.array_contains(known, k) | F.array_contains(F.col("_bad"), k))
    whole = F.to_json(F.create_map(F.lit(CORRUPT), F.col(text)))
    rescued = F.when(F.col("_raw").isNull() & F.col(text).isNotNull(), whole).when(F.size("_rest") > 0, F.to_json("_rest"))
    others = [c for c in lines.columns if c != text and c not in schema.names]
    return parsed.withColumn("_bad", bad).withColumn("_rest", rest).select(
        *[c.alias(n) for n, c in fields.items()], *others, rescued.alias(RESCUED))


def typed_csv(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as columns of ``schema``; misfits by name, and the whole line where its columns do not add up."""
    fields = {f.name: _typed(F.col(f.name), f.dataType) for f in schema.fields}
    misfit = [F.when(F.col(n).isNotNull() & c.isNull(), F.struct(F.lit(n).alias("key"), F.col(n).alias("value"))) for n, c in fields.items()]
    line = F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit(CORRUPT).alias("key"), F.col(CORRUPT).alias("value")))
    found = F.array_compact(F.array(*misfit, line))
    return rows.select(
        *[c.alias(n) for n, c in fields.items()], F.when(F.size(found) > 0, F.to_json(F.map_from_entries(found))).alias(RESCUED))


def inferred_stream(spark: SparkSession, path: str, location: str, fmt: str = "json", max_files: int = MAX_FILES) -> DataFrame:
    """Incremental read under the schema stored at ``location``, with a ``_rescued`` column.

    A restart reads the stored schema, so types never flip between runs whatever arrives later.
    """
    schema = stored_schema(spark, path, fmt, location)
    if fmt == "json":
        return typed_documents(file_stream(spark, path, "value string", "text", max_files), schema)
    plain = T.StructType([*[T.StructField(n, T.StringType()) for n in schema.names], T.StructField(CORRUPT, T.StringType())])
    return typed_csv(file_stream(spark, path, plain, "csv", max_files, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT), schema)


# -- evolved by the registry ----------------------------------------------

class SchemaChanged(Exception):
    """A micro-batch widened the registered schema; the stream restarts under the new version."""


#: Type changes that lose nothing: the wider type replaces the narrower one.
WIDER = {("bigint", "double"): "double", ("void", "bigint"): "bigint", ("void", "double"): "double", ("void", "string"): "string",
         ("void", "boolean"): "boolean"}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(REGISTRY).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)


def batch_schema(docs: DataFrame, text: str) -> T.StructType:
    """Top-level fields of a batch of JSON documents with their types; one row per field comes back."""
    rows = registry.observed_fields(docs, text, depth=1).collect()
    return T.StructType([T.StructField(r["path"], T._parse_datatype_string(r["type"])) for r in sorted(rows, key=lambda r: r["path"])])


def evolution(known: T.StructType | None, seen: T.StructType) -> tuple[str, T.StructType]:
    """``same``, ``wider`` or ``breaking``, and the schema to go on with.

    New fields and the type changes of ``WIDER`` widen.  A field that is missing from a batch is NULL there.
    """
    if known is None:
        return "wider", seen
    have, verdict, out = {f.name: f.dataType.simpleString() for f in known.fields}, "same", list(known.fields)
    for f in seen.fields:
        old, new = have.get(f.name), f.dataType.simpleString()
        if old is None:
            verdict, out = "wider", [*out, f]
        elif old != new and new != "void" and (new, old) not in WIDER:
            if (old, new) not in WIDER:
                return "breaking", known
            verdict = "wider"
            out = [T.StructField(g.name, T._parse_datatype_string(WIDER[old, new])) if g.name == f.name else g for g in out]
    return verdict, T.StructType(out)


def evolving_ingest(spark: SparkSession, table: str, path: str, target: str, checkpoint: str, registry_path: str, at, max_files: int = MAX_FILES) -> list[str]:
    """Process everything that has arrived; what each micro-batch met: ``same``, ``wider`` or ``breaking``.

    Each run streams under the registry's active version.  A micro-batch that fits is written as its own part of the
    target (run again after a failure, it overwrites that part).  One that widens the schema stops the query: the
    next version is registered and the stream restarts from its checkpoint with the same micro-batch.  One that
    breaks it goes to ``<target>_quarantine`` as it came, and the stream goes on.
    """
    met: list[str] = []

    def handle(docs: DataFrame, number: int):
        versions = read_registry(spark, registry_path)
        known = registry.active_schema(versions, table)
        verdict, schema = evolution(known, batch_schema(docs, "value"))
        met.append(verdict)
        if verdict == "wider":
            event, row = registry.detect(spark, versions, table, schema, at) if known is None else (
                None, registry.new_version(versions, table, schema, _changes(known, schema), at, "dqflow"))
            row.write.mode("append").parquet(registry_path)
            raise SchemaChanged(f"{table}: {len(schema)} fields")
        place = f"{target}_quarantine/part={number}" if verdict == "breaking" else f"{target}/part={number}"
        (docs if verdict == "breaking" else typed_documents(docs, known)).write.mode("overwrite").parquet(place)

    while True:
        before = len(met)
        query = for_each(file_stream(spark, path, "value string", "text", max_files), handle, checkpoint)
        try:
            query.awaitTermination()
            return met
        except Exception:
            # Only the restart that was asked for; anything else ends the run.
            if met[before:] and met[-1] == "wider":
                continue
            raise


def _changes(known: T.StructType, schema: T.StructType) -> list[dict]:
    have = {f.name: f.dataType.simpleString() for f in known.fields}
    return [{"path": f.name, "change": "field_added" if f.name not in have else "data_type_changed"}
            for f in schema.fields if have.get(f.name) != f.dataType.simpleString()]


def read_evolved(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All parts under the newest schema: parts are read with their own types, then widened."""
    names = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = names.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [spark.read.parquet(s.getPath().toString()) for s in store.listStatus(names)]
    by_layout: dict[str, list[str]] = {}
    for p in parts:
        by_layout.setdefault(p.schema.json(), []).extend(p.inputFiles())
    wide = [*schema.fields, T.StructField(RESCUED, T.StringType())]

    def widened(files):
        df = spark.read.parquet(*files)
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wide])

    return registry.union_all([widened(files) for files in by_layout.values()])
