"""Helpers shared by the corpus operators: stored steps, let-bindings and exact regular-expression spans."""

from __future__ import annotations

import gc
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.session import work_dir

#: Words of the quality, mixing and language-model contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Separators of normalised words (license and benchmark contracts), applied after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send the module's functions to Python workers by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later steps neither recompute nor lose it."""
    path = work_dir(df.sparkSession, f"llm-{name}")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``saved`` step that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any letter case: an operator's own columns replace them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running_sum(a: Column) -> Column:
    """Inclusive prefix sums of a long array in O(n log n), by doubling steps."""
    steps = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int"))),
        lambda j: F.call_function("shiftleft", F.lit(1), j),
    )
    return F.aggregate(
        steps, a,
        lambda acc, d: F.when(F.size(acc) <= d, acc).otherwise(
            F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - d), F.lit(0).cast("bigint")))
        ),
    )


def spans(text: Column, pattern: Column, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array<struct<start, end, hit, part>>, in code points, end exclusive.

    ``part`` is the capture group asked for.  The gaps between matches come from ``split``, whose
    lengths and those of the matches add up to the positions.
    """
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"),
        (F.regexp_extract_all(text, pattern, F.lit(group)) if group else F.array().cast("array<string>")).alias("parts"),
    )

    def located(v):
        steps = F.transform(v["hits"], lambda h, i: (F.length(v["gaps"][i]) + F.length(h)).cast("bigint"))
        return let(
            running_sum(steps),
            lambda ends: F.transform(v["hits"], lambda h, i: F.struct(
                (ends[i] - F.length(h)).alias("start"), ends[i].alias("end"), h.alias("hit"),
                (v["parts"][i] if group else h).alias("part"),
            )),
        )

    return let(found, lambda v: F.when(
        F.size(v["hits"]) == 0,
        F.array().cast("array<struct<start:bigint,end:bigint,hit:string,part:string>>"),
    ).otherwise(located(v)))


def span_text(items: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined in the array's order."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
