"""Operator 9: mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqflow.llm.common import WORD, text_of, without

OWN = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share=1.0, max_epochs=3) -> DataFrame:
    """Targets of sources: ``sizes`` has source and source_size, one row each.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` of all words.
    A target stops at ``max_epochs`` times its source; the rest is shared again by weight.  That fixed
    point is least(cap, level * weight): in the order of cap / weight the level that the uncapped
    sources would get rises as long as a source is capped and never after, so it is the largest one.
    The windows without partitions order one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("_turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn") + 1))
        .withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(everything) * F.lit(float(share)))
        .withColumn("_weights", F.sum("_weight").over(everything))
    )
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_weight")).alias("target"))
    )


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), share=1.0,
                max_epochs=3, seed="mix", rows_per_slice=5_000) -> DataFrame:
    """``docs`` with size, source_size, target and taken; every input row stays.

    Each row gets a hash-random key from its id and text, so rows without an id or with one id spread too.  Keys are uniform, so cutting their range into equal slices
    range-partitions every source evenly, hot ones included: one row per (source, slice) carries
    the sum, prefix sums over those rows give each slice its offset, and rows are ordered only within
    their slice.  The cut is exact: whole epochs first, then documents in key order until the budget
    (the target rounded to words) is used; the document at the cut is taken in part.

    Null text has size 0, a null source is a source of its own and comes last, a null id counts as an
    empty one.  Rows alike in id and text share a key.  Repeated rows are mixed as rows of their own.
    An empty table gives no rows.  Other columns pass through; columns named like the results are replaced.
    """
    n_slices = max(1, -(-docs.count() // rows_per_slice))
    source, key = F.col(source_col), F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col).cast("binary"))))
    base = without(
        docs.withColumns({
            "_size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint"),
            "_named": source.isNotNull(),
            "_source": F.coalesce(source.cast("string"), F.lit("")),
            "_key": key,
        }), *OWN,
    ).withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * n_slices / F.lit(2 ** 32)).cast("int"))
    own = ["_named", "_source", "_slice"]
    slices = base.groupBy(*own).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_named", "_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    sizes = slices.groupBy("_named", "_source").agg(F.sum("_sum").alias("source_size")).select(
        F.when(F.col("_named"), F.col("_source")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, share, max_epochs).select(
        F.col("source").isNotNull().alias("_named"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    plan = offsets.join(targets, ["_named", "_source"]).drop("_sum")
    inside = Window.partitionBy(*own).orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    start = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return (
        base.join(plan, own)
        .withColumn("_epochs", epochs)
        .withColumn("_left", budget - F.col("_epochs") * F.col("source_size"))
        .withColumn("_start", start)
        .withColumn("taken", (F.col("_epochs") * F.col("_size") + F.greatest(
            F.lit(0), F.least(F.col("_size"), F.col("_left") - F.col("_start")))).cast("bigint"))
        .withColumnRenamed("_size", "size")
        .drop("_named", "_source", "_key", "_slice", "_offset", "_epochs", "_left", "_start")
    )
