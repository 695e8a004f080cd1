"""Operator 12: exact duplicates by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import lower_ascii, saved, text_of
from dqflow.operators.skew import hot_keys, join_unique

#: A hot digest is dealt to this many salted groups, by the task that read the row.
SALTS = 64


def groups_of_equal_texts(texts: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """_digest, keep_id, group_size per distinct content of ``texts`` (_id, _digest, _text).

    Each aggregation has the whole text in its key: within a task (before the shuffle), among the winners of one
    digest and salt, and among the winners of the salts of a hot digest.  Digests that are not hot have one salt and
    are complete after the second step, so their texts travel once.
    """
    best = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    spread = texts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_digest", "left").select(
        "_digest", "_text", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.when(F.col("_hot"), F.pmod(F.spark_partition_id(), F.lit(salts)) + 1).otherwise(0).alias("_salt"))
    winners = spread.groupBy("_digest", "_salt", "_text").agg(*best)
    if hot.isEmpty():
        return winners.select("_digest", "keep_id", "group_size")
    winners = saved(winners.withColumn("_text", F.when(F.col("_salt") > 0, F.col("_text"))), "winners")
    merged = winners.where("_salt > 0").groupBy("_digest", "_text").agg(*best)
    return winners.where("_salt = 0").drop("_salt", "_text").unionByName(merged.drop("_text"))


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", digest=None, salts=SALTS) -> DataFrame:
    """Per row: _id, keep_id, group_size, kept, text_sha256 (of the text after lower-casing A-Z).

    Texts are equal when their whole contents are; ``digest`` (a function of the text's column, SHA-256 unless given)
    only brings candidates together.  The shuffle of the texts is dealt by digest and salt, and everything else moves
    ids and digests.  Digests of two different contents are settled by the text itself, so a weak digest costs
    time, not rightness.

    Null texts are empty texts.  Of equal texts the row with the largest id stays, null ids coming last; where
    several rows share that id, exactly one of them stays (they give equal rows otherwise), so each group keeps
    one row, with a null ``keep_id`` if it has no ids at all.  An empty table gives no rows; other columns are ignored.
    """
    text = lower_ascii(text_of(text_col))
    of = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_digest", of(F.col("_text")))
    rows = saved(texts.select(
        "_id", "_digest", F.sha2("_text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")), "digests")
    hot = saved(hot_keys(rows, "_digest"), "hot")
    groups = saved(groups_of_equal_texts(texts, hot, salts), "groups")
    clashing = saved(groups.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_digest"), "clashing")
    if clashing.isEmpty():
        found = join_unique(rows, groups, "_digest", "inner")
    else:
        clear = groups.join(clashing, "_digest", "left_anti")
        found = join_unique(rows, clear, "_digest", "inner").unionByName(_by_content(texts, rows, clashing, salts))
    return _one_row_each(found).select("_id", "keep_id", "group_size", "kept", "text_sha256")


def _by_content(texts: DataFrame, rows: DataFrame, clashing: DataFrame, salts: int) -> DataFrame:
    """The rows of digests that several contents share, looked up by SHA-256 and then told apart by the text itself."""
    strong = texts.join(clashing, "_digest", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
    salted = strong.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    best = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    groups = (
        salted.groupBy("_digest", "text_sha256", "_text", "_salt").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .groupBy("_digest", "text_sha256", "_text").agg(*best).drop("_text"))
    return join_unique(rows.join(clashing, "_digest", "left_semi"), groups, ["_digest", "text_sha256"], "inner")


def _one_row_each(found: DataFrame) -> DataFrame:
    """``kept``: the row with the group's id, only the last of them where rows share that id."""
    found = found.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    top = found.where("kept").groupBy("_digest", "text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.max("_row").alias("_last")).where("_n > 1")
    top = saved(top.drop("_n"), "shared-ids")
    if top.isEmpty():
        return found
    marked = join_unique(found, top, ["_digest", "text_sha256"])
    return marked.withColumn("kept", F.col("kept") & (F.col("_last").isNull() | (F.col("_row") == F.col("_last"))))
