"""Joins and lookups that stay even when one key holds a third of all rows.

Keys with more than ``rows / (HOT_SHARE * shuffle partitions)`` rows are looked up
by broadcast.  At most ``HOT_SHARE * shuffle partitions`` keys can be that frequent,
so the list needs no limit, and any other key is a fraction of an average
partition of the remaining shuffle join, at every size of the input.
Rows of hot keys, and rows whose key is NULL, only pass through that shuffle
under a salt that spreads them evenly; they find no partner there.

The salt is the number of the task that reads the row: a hot key ends up on as
many reducers as tasks hold it, and a lost task that is computed again sends
its rows where they went before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqflow.session import work_dir
from dqflow.sources.tables import files_under

HOT_SHARE = 2
#: A stored look-up of at most so many rows and bytes of Parquet is sent to every task.
SMALL_ROWS, SMALL_BYTES = 500_000, 16 << 20


def as_list(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def all_not_null(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def hottest(counted: DataFrame, rows: str, min_rows=None) -> DataFrame:
    """The keys with more than their share of the rows, or with ``min_rows`` where that is given."""
    if min_rows is not None:
        return counted.where(F.col(rows) >= min_rows)
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.where(F.col(rows) > counted.agg(F.sum(rows)).scalar() / (HOT_SHARE * partitions))


def hot_keys(df: DataFrame, keys, min_rows=None) -> DataFrame:
    keys = as_list(keys)
    counts = df.where(all_not_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return hottest(counts, "_rows", min_rows).select(*keys)


def _probe(fact: DataFrame, hot_dim: DataFrame, dim: DataFrame, keys, extra, how: str) -> DataFrame:
    packed = hot_dim.select(*keys, F.struct(F.lit(True).alias("__m"), *extra).alias("__hot"))
    spread = F.spark_partition_id().cast("long") + 1
    rows = fact.join(F.broadcast(packed), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull() | ~all_not_null(keys), spread).otherwise(F.lit(0).cast("long"))
    )
    # Always 0, but not a literal: the optimizer would fold a literal out of the
    # join keys and the salt would no longer take part in the shuffle.
    unsalted = F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")).alias("__salt")
    cold = dim.select(*keys, unsalted, F.struct(F.lit(True).alias("__m"), *extra).alias("__cold"))
    both = rows.join(cold, [*keys, "__salt"], "left").withColumn("__pick", F.coalesce("__hot", "__cold"))
    if how == "inner":
        both = both.where("__pick.__m")
    return both.select(*fact.columns, *[F.col("__pick")[c].alias(c) for c in extra])


def join_unique(fact: DataFrame, dim: DataFrame, keys, how="left", source: DataFrame | None = None,
                min_rows=None) -> DataFrame:
    """Equi-join a large table with a side that holds one row per key.

    ``how`` is ``left`` or ``inner``.  ``source`` is a cheaper table with the
    same key column to count hot keys on, for a fact that is itself a join.
    """
    keys = as_list(keys)
    extra = [c for c in dim.columns if c not in keys]
    hot = hot_keys(fact if source is None else source, keys, min_rows)
    hot_dim = dim.join(F.broadcast(hot), keys, "inner")
    return _probe(fact, hot_dim, dim, keys, extra, how)


def stored_lookup(dim: DataFrame) -> tuple[DataFrame, bool]:
    """The looked-up side written once, and whether it is small enough to be sent to every task."""
    spark, path = dim.sparkSession, work_dir(dim.sparkSession, "lookup")
    dim.write.parquet(path)
    stored = spark.read.parquet(path)
    return stored, sum(f[1] for f in files_under(spark, path)) <= SMALL_BYTES and stored.count() <= SMALL_ROWS


def look_up(fact: DataFrame, dim: DataFrame, keys, how="left", source: DataFrame | None = None) -> DataFrame:
    """``join_unique`` that knows the size of ``dim``: rows travel only if it is not small."""
    keys = as_list(keys)
    dim, small = stored_lookup(dim)
    if not small:
        return join_unique(fact, dim, keys, how, source)
    return fact.join(F.broadcast(dim), keys, how).select(*fact.columns, *[c for c in dim.columns if c not in keys])


def look_up_and_flag(fact: DataFrame, dim: DataFrame, key: str, finer, order: list, name: str,
                     source: DataFrame | None = None) -> DataFrame:
    """Left look-up of ``dim`` (one row per ``key``), and the flag of rows that have a strictly smaller row (by ``order``)
    of the same ``finer`` key, ``key`` among its columns: the rows travel once for both.

    Rows are dealt by ``key`` and a salt.  Rows of a hot ``key`` look up by broadcast and are salted by ``finer``; a hot
    ``finer`` key is one of a hot ``key``, so such keys are counted among those rows only and get their smallest
    row by broadcast.
    """
    finer, base = as_list(finer), fact if source is None else source
    extra = [c for c in dim.columns if c != key]
    dim, small = stored_lookup(dim)
    hot = hot_keys(base, key)
    groups = base.join(F.broadcast(hot), key).where(all_not_null(finer)).groupBy(*finer).agg(
        F.min(F.struct(*order)).alias("__least"), F.count(F.lit(1)).alias("_rows"))
    rows = fact.join(F.broadcast(hottest(groups, "_rows").drop("_rows")), finer, "left")
    rows = rows.join(F.broadcast(hot.withColumn("__is_hot", F.lit(True))), key, "left")
    alone = F.spark_partition_id().cast("long") + 1
    together = F.col("__least").isNull() & all_not_null(finer)
    salt = F.when(F.col(key).isNull() | (F.col("__is_hot") & ~together), alone).when(
        F.col("__is_hot"), F.pmod(F.xxhash64(*finer), F.lit(1 << 31)) + 1).otherwise(F.lit(0).cast("long"))
    if small:
        both = rows.withColumn("__salt", salt).join(F.broadcast(dim.select(key, F.struct(*extra).alias("__pick"))), key, "left")
    else:
        hot_dim = dim.join(F.broadcast(hot), key).select(key, F.struct(*extra).alias("__hot"))
        rows = rows.join(F.broadcast(hot_dim), key, "left").withColumn("__salt", salt)
        unsalted = F.pmod(F.xxhash64(key), F.lit(1).cast("long")).alias("__salt")
        both = rows.join(dim.select(key, unsalted, F.struct(*extra).alias("__cold")), [key, "__salt"], "left").withColumn(
            "__pick", F.coalesce("__hot", "__cold"))
    mine = F.struct(*order)
    least = F.coalesce("__least", F.min(mine).over(W.partitionBy(*finer, "__salt")))
    flag = all_not_null(finer) & F.coalesce(mine > least, F.lit(False))
    return both.withColumn(name, flag).select(*fact.columns, *[F.col("__pick")[c].alias(c) for c in extra], name)


def attach_stats(df: DataFrame, keys, aggs, source: DataFrame | None = None, min_rows=None, group_rows: int = 1, few: bool = False) -> DataFrame:
    """Group aggregates joined back onto every row of the group.

    The aggregation combines map-side, so a hot group reaches the reducer as
    one partial row per task; the hottest groups of that same aggregate are the
    ones joined back by broadcast.  ``aggs`` are aliased aggregate columns.
    Groups of fewer than ``group_rows`` rows are not joined back: their rows get NULL.
    With ``few`` the aggregates are stored first and, if they are few, sent to every task: then no row travels.
    """
    keys = as_list(keys)
    base = df if source is None else source
    stats = base.where(all_not_null(keys)).groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    extra = [c for c in stats.columns if c not in keys and c != "_rows"]
    if few:
        stats, small = stored_lookup(stats)
        if small:
            return df.join(F.broadcast(stats.drop("_rows")), keys, "left").select(*df.columns, *extra)
    # The filter keeps the count in use so that both sides share one aggregation.
    return _probe(df, hottest(stats, "_rows", min_rows), stats.where(F.col("_rows") >= group_rows), keys, extra, "left")


def flag_member(fact: DataFrame, keys_df: DataFrame, keys, name: str, **kw) -> DataFrame:
    """Add a boolean column telling whether the key occurs in ``keys_df``."""
    keys = as_list(keys)
    dim = keys_df.select(*keys).where(all_not_null(keys)).distinct().withColumn(name, F.lit(True))
    return join_unique(fact, dim, keys, "left", **kw).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def known(fact: DataFrame, keys_df: DataFrame, keys, name: str, source: DataFrame | None = None) -> DataFrame:
    """``flag_member`` that knows the number of keys: rows travel only if they are not few."""
    keys = as_list(keys)
    dim = keys_df.select(*keys).where(all_not_null(keys)).distinct().withColumn(name, F.lit(True))
    return look_up(fact, dim, keys, source=source).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def first_per_key(df: DataFrame, keys, order: list) -> DataFrame:
    """One row per key, the smallest by ``order``, as a combining aggregate.

    No group is gathered: each task keeps one candidate per key.  Rows equal in
    every ordering column are told apart by the remaining columns, so exactly
    one survives even among full copies.
    """
    return _extreme_per_key(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys, order: list) -> DataFrame:
    """One row per key, the largest by ``order``."""
    return _extreme_per_key(df, keys, order, F.max)


def _extreme_per_key(df, keys, order, pick):
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    maps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)}
    # Maps have no order; their sorted entries do.
    packed = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rest]
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *packed)).alias("_best")).select(*keys, "_best.*")
    return best.select(*[F.map_from_entries(c).alias(c) if c in maps else c for c in df.columns])
