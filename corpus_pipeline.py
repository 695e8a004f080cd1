"""Training-data pipeline: quality rules, near duplicates, decontamination, personal data, source mixing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqflow.llm.common import saved, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    from dqflow.llm.quality import quality_rules

    return quality_rules(docs).where("kept").select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by a similarity of 0.8 or more."""
    from dqflow.llm.near import keep_one

    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    from dqflow.llm.decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced in the text; n_chars follows the new text."""
    from dqflow.llm.pii import sanitize

    clean = sanitize(docs).select(*[F.col("sanitized").alias("text") if c == "text" else F.col(c) for c in docs.columns])
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each over all epochs."""
    from dqflow.llm.mixing import mix_sources

    return mix_sources(docs).where("taken > 0").select(*docs.columns, "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("source mix", mixed),
]

#: Robust outliers, Bayesian pruning and disclosure have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
