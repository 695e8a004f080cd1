"""Operator 6: quality rules with robust multivariate outliers (minimum covariance determinant per language and source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqflow.llm.common import let, saved, text_of, without

SPACES = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, each with the standard deviation below which spread counts as noise.
FEATURES = {"f_symbols": 0.25, "f_capitals": 0.25, "f_marks": 0.25, "f_length": 0.12, "f_repeats": 0.12, "f_lines": 0.12}
GRID = 1000


def words_of(text: Column) -> Column:
    """The words in order; the array of one empty string where there is none."""
    return F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def window_keys(words: Column) -> Column:
    """The 3-word windows in sorted order, one long each: 40 bits of hash over 24 bits of position."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.shiftleft(F.xxhash64(words[i], words[i + 1], words[i + 2]), 24).bitwiseOR(i.cast("bigint")))))


def repeated_words(words: Column, keys: Column) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    Neighbours in ``keys`` with one hash differ in the low bits only; their words are compared.
    The sorted starts then cover min(3, distance to the next) words each.
    """
    low = F.lit(16777215).cast("bigint")

    def equal(a, b):
        return (words[a] == words[b]) & (words[a + 1] == words[b + 1]) & (words[a + 2] == words[b + 2])

    near = F.filter(
        F.when(F.size(keys) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(keys) - 2)),
        lambda j: keys[j].bitwiseXOR(keys[j + 1]).between(0, 16777215))
    pairs = F.filter(
        F.transform(near, lambda j: F.array(keys[j].bitwiseAND(low).cast("int"), keys[j + 1].bitwiseAND(low).cast("int"))),
        lambda p: equal(p[0], p[1]))
    return let(F.sort_array(F.array_distinct(F.flatten(pairs))), lambda d: F.aggregate(
        F.transform(d, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(d, j + 1), x + 3) - x)),
        F.lit(0).cast("bigint"), lambda a, b: a + b))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions read instead of computing them again, also inside lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def statistics(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with the counts, base_failed and the transformed statistics."""
    t = text_of(text_col)
    spaced = held(docs, _words=words_of(t), _lines=F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    counted = held(
        held(spaced, _keys=window_keys(F.col("_words"))),
        word_chars=F.length(F.array_join("_words", "")).cast("bigint"),
        n_words=F.when(F.col("_words")[0] == "", 0).otherwise(F.size("_words")).cast("bigint"),
        n_symbols=F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        n_repeat_words=repeated_words(F.col("_words"), F.col("_keys")),
        _n_lines=F.size("_lines"),
        _capitals=F.regexp_count(t, F.lit("[A-Z]")),
        _marks=F.regexp_count(t, F.lit(r"[!?{}\[\]=\\~^]")),
    )
    n = F.col("n_words").cast("double")
    # Smoothed by a few words or lines of nothing special, so that short texts lie near the middle.
    features = {
        "f_symbols": F.log1p(100 * F.col("n_symbols") / (n + 10)),
        "f_capitals": F.asin(F.sqrt(F.col("_capitals") / (F.col("word_chars") + 20.0))) * 3,
        "f_marks": F.log1p(100 * F.col("_marks") / (n + 10)),
        "f_length": F.log((F.col("word_chars") + 100.0) / (n + 20)),
        "f_repeats": F.asin(F.sqrt(F.col("n_repeat_words") / (n + 10))),
        "f_lines": F.asin(F.sqrt(F.col("n_dup_lines") / (F.col("_n_lines") + 4.0))),
    }
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ).withColumns({k: F.round(v * GRID).cast("bigint") for k, v in features.items()}).drop(
        "_words", "_lines", "_keys", "_n_lines", "_capitals", "_marks")


def _quantile_rows(counts: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The smallest ``value`` per key at which the cumulated ``n`` reaches ``share`` of all; one row per distinct value."""
    w = Window.partitionBy(*keys)
    return (
        counts.withColumn("_cum", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("n").over(w))
        .where(F.col("_cum") >= F.col("_all") * share)
        .groupBy(*keys).agg(F.min(value).alias("cut"))
    )


def _first_model(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and quartile spreads from a histogram on a grid of 0.01: one row per key."""
    long = vectors.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.round(F.col(f) / 10) * 10).cast("bigint").alias("value")) for f in FEATURES
    ])).alias("_x")).select(*keys, "_x.*")
    counts = long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    by = [*keys, "feature"]
    w = Window.partitionBy(*by)
    spread = (
        counts.withColumn("_cum", F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("n").over(w))
        .groupBy(*by).agg(*[
            F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col("value"))).alias(name)
            for name, q in (("_low", 0.25), ("_mid", 0.5), ("_high", 0.75))])
    )
    out = []
    for f, floor in FEATURES.items():
        mine = F.col("feature") == f
        out.append(F.max(F.when(mine, F.col("_mid").cast("double"))).alias(f"m_{f}"))
        sd = F.greatest((F.col("_high") - F.col("_low")) / 1.349, F.lit(floor * GRID))
        out.append(F.max(F.when(mine, sd)).alias(f"l_{f}_{f}"))
    zero = [F.lit(0.0).alias(f"l_{a}_{b}") for a, b in _below()]
    return spread.groupBy(*keys).agg(*out).select("*", *zero)


def _below():
    names = list(FEATURES)
    return [(a, b) for i, a in enumerate(names) for b in names[:i]]


def _distance(vectors: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution with the model's Cholesky factor."""
    out = vectors.join(model, keys, "left")
    for i, a in enumerate(FEATURES):
        rest = F.col(a) - F.col(f"m_{a}")
        for b in list(FEATURES)[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        out = out.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    return out.withColumn("d2", sum(F.col(f"z_{a}") * F.col(f"z_{a}") for a in FEATURES)).select(*vectors.columns, "d2")


def _moments(kept: DataFrame, keys: list[str], inflate: float) -> DataFrame:
    """Means and Cholesky factor of the covariance of ``kept``, whose variances get the floors added.

    Sums of integers on the grid do not depend on the order of rows.
    """
    names = list(FEATURES)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    sums = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(a).cast("double").alias(f"s_{a}") for a in names],
        *[F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)")).cast("double").alias(f"s_{a}_{b}") for a, b in pairs])
    out = sums.withColumns({f"m_{a}": F.col(f"s_{a}") / F.col("_n") for a in names})
    out = out.withColumns({
        f"c_{a}_{b}": (F.col(f"s_{a}_{b}") / F.col("_n") - F.col(f"m_{a}") * F.col(f"m_{b}")) * inflate
        + ((FEATURES[a] * GRID) ** 2 if a == b else 0.0) for a, b in pairs})
    for i, a in enumerate(names):
        for b in names[:i]:
            dot = F.col(f"c_{a}_{b}")
            for c in names[: names.index(b)]:
                dot = dot - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            out = out.withColumn(f"l_{a}_{b}", dot / F.col(f"l_{b}_{b}"))
        rest = F.col(f"c_{a}_{a}")
        for c in names[:i]:
            rest = rest - F.col(f"l_{a}_{c}") * F.col(f"l_{a}_{c}")
        out = out.withColumn(f"l_{a}_{a}", F.sqrt(F.greatest(rest, F.lit((FEATURES[a] * GRID) ** 2 * 0.25))))
    return out.select(*keys, *[f"m_{a}" for a in names], *[f"l_{a}_{a}" for a in names], *[f"l_{a}_{b}" for a, b in _below()])


def robust_models(vectors: DataFrame, keys: list[str], share=0.75, steps=3, inflate=1.6) -> DataFrame:
    """Minimum covariance determinant per key by concentration steps.

    The start is the median and quartile spread.  Each step keeps the ``share`` of rows with the
    smallest distance (cut on a logarithmic histogram of 50 bins per unit, so one row per bin is ordered)
    and takes their mean and covariance; ``inflate`` makes up for the rows left out.
    """
    model = saved(_first_model(vectors, keys), "mcd")
    for _ in range(steps):
        near = _distance(vectors, model, keys).withColumn("_bin", F.ceil(F.log(F.col("d2") + 1e-6) * 50).cast("int"))
        bins = near.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n"))
        # Written tables have a known size: one row per key, joined without shuffling the rows where it is small.
        cut = saved(_quantile_rows(bins, keys, "_bin", share), "mcd-cut")
        model = saved(_moments(near.join(cut, keys).where(F.col("_bin") <= F.col("cut")), keys, inflate), "mcd")
    return model


def _scopes(vectors: DataFrame, min_rows: int) -> DataFrame:
    """_judge, the model that judges a (language, source), and _feeds, the models that its rows are part of.

    A wider model, with ``*`` for the source or for both, has all rows of its language or table and is only
    fitted where a key or language of fewer than ``min_rows`` rows needs it.
    """
    sized = vectors.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    langs = sized.groupBy("_lang").agg(F.sum("_n").alias("_of_lang"), F.min("_n").alias("_least"))
    tables = langs.agg(F.min("_of_lang").alias("_least_lang"))
    scope = lambda lang, source: F.struct(lang.alias("_lang"), source.alias("_source"))
    own, lang, every = scope(F.col("_lang"), F.col("_source")), scope(F.col("_lang"), F.lit("*")), scope(F.lit("*"), F.lit("*"))
    alone, by_lang = F.col("_n") >= min_rows, F.col("_of_lang") >= min_rows
    return sized.join(langs, "_lang").crossJoin(tables).select(
        "_lang", "_source", F.when(alone, own).when(by_lang, lang).otherwise(every).alias("_judge"),
        F.array_compact(F.array(
            F.when(alone, own), F.when(by_lang & (F.col("_least") < min_rows), lang),
            F.when(F.col("_least_lang") < min_rows, every))).alias("_feeds"))


def quality_rules(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", cutoff=100.0, min_rows=30,
                  share=0.75, steps=3) -> DataFrame:
    """``docs`` with the counts, base_failed, d2 and kept.

    A row is kept unless the base rules fail or its squared distance from the robust model of its (language,
    source) exceeds ``cutoff``.  Models are fitted on all rows that have a word; keys of fewer than ``min_rows``
    such rows are judged by the model of all rows of their language, languages of fewer by that of all rows, so
    that every row with a word has a distance.  Null languages and sources are keys of their own.  Null and empty texts have no words and fail the base rules.  Repeated rows count as often as
    they occur.  An empty table gives no rows.  Columns named like the results are replaced.
    """
    keys = ["_lang", "_source"]
    own = (*COUNTS, "base_failed", "d2", "kept", *FEATURES)
    base = docs.withColumns({
        "_text": text_of(text_col), **{k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
                                       for k, c in zip(keys, (lang_col, source_col))}})
    counted = statistics(without(base, *own), "_text")
    vectors = saved(counted.where("n_words > 0").select(*keys, *FEATURES), "vectors")
    scopes = saved(_scopes(vectors, min_rows), "scopes")
    model = robust_models(vectors.join(scopes, keys).select(F.inline("_feeds"), *FEATURES), keys, share, steps)
    placed = counted.join(scopes.select(*keys, "_judge"), keys, "left").withColumns({k: F.col("_judge")[k] for k in keys}).drop("_judge")
    judged = _distance(placed, model, keys)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).drop(
        *keys, "_text", *FEATURES)
