"""Operator 10: URL filter, host-suffix and path-prefix rules before a logistic regression on hashed n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import let, lower_ascii, without

#: (verdict, host, path) of the query's contract.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without :// or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; equally long ones in the order of the list."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column, sizes=(2, 3, 4)) -> Column:
    """Character n-grams of host and path, told apart and closed with ^ and $; linear in the length."""
    def cut(chars, mark, n):
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))),
            lambda i: F.concat(F.lit(mark), *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)]))

    def of(c, mark):
        return let(F.split(F.concat(F.lit("^"), c, F.lit("$")), ""),
                   lambda chars: F.flatten(F.array(*[cut(chars, mark, n) for n in sizes])))

    return F.concat(of(host, "h:"), of(path, "p:"))


def _features(df: DataFrame, buckets: int) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True).transform(
        df.withColumn("_grams", grams(F.col("host"), F.col("path"))))


def fit_url_model(labelled: DataFrame, buckets=2 ** 14, reg=0.002, iterations=30) -> LogisticRegressionModel | None:
    """Logistic regression on ``labelled`` (host, path, blocked 0/1); None where one of the classes is missing."""
    rows = _features(labelled.where(F.col("blocked").isNotNull()), buckets).withColumn("_label", F.col("blocked").cast("double"))
    if len(labelled.select("blocked").where("blocked IS NOT NULL").distinct().limit(2).collect()) < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="_label", regParam=reg, maxIter=iterations,
                              standardization=False, probabilityCol="_probability", rawPredictionCol="_raw",
                              predictionCol="_blocked").fit(rows)


def labelled_urls(pages: DataFrame, url_col="url", rules=RULES, bound=2000, skip: Column | None = None) -> DataFrame:
    """The small labelled table: at most ``bound`` distinct (host, path) that rules decide, lowest hashes first.

    ``bound`` is the documented limit of the training sample; ``skip`` holds rows out of it.
    """
    parts = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).where("_rule IS NOT NULL")
    if skip is not None:
        ruled = ruled.where(~skip)
    return (
        ruled.select("host", "path", F.when(F.col("_rule.verdict") == "block", 1).otherwise(0).alias("blocked"))
        .distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(bound)
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, url_col="url", rules=RULES, default="allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and probability (of block; null where no model exists).

    The rule's verdict stands; other urls get the model's, ``default`` where the labelled table has one class
    only or is empty.  Null urls and urls without :// have empty host and path, which the model judges too.
    Repeated rows stay, columns named like the results are replaced, an empty table gives no rows.
    """
    own = ("host", "path", "rule", "verdict", "probability")
    url = F.col(url_col)
    parts = without(pages.withColumns({"_host": host_of(url), "_path": path_of(url)}), *own).withColumnsRenamed(
        {"_host": "host", "_path": "path"}).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    model = fit_url_model(labelled)
    if model is None:
        scored = parts.withColumn("probability", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(_features(parts, model.numFeatures)).withColumn(
            "probability", vector_to_array(F.col("_probability"))[1])
    judged = F.when(F.col("probability") >= 0.5, "block").when(F.col("probability") < 0.5, "allow").otherwise(F.lit(default))
    return scored.withColumns({
        "rule": F.col("_rule.rule"), "verdict": F.coalesce(F.col("_rule.verdict"), judged),
    }).drop("_rule", "_grams", "_features", "_raw", "_probability", "_blocked")
