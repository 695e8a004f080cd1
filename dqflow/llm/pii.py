"""Operator 2: personal data, and information-theoretic sanitisation of the terms that reveal it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import dropped, let, released, saved, span_text, spans, text_of, without
from dqflow.operators.skew import join_unique

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive quantifiers and look-behinds bound backtracking and match the same places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text before its pattern is tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
SPAN = "struct<start:bigint,end:bigint,order:int,kind:string>"
TERM = r"[\p{L}\p{M}]+"


def luhn(number: Column) -> Column:
    """True where the digits among the characters pass the Luhn check."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _good(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.rlike(hit, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    n = F.regexp_count(hit, F.lit("[0-9]"))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(hit)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _found(text: Column, make) -> Column:
    """``make(order, kind, match)`` of all personal data, by kind as listed, then start."""
    def of(i, kind):
        hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else F.rlike(text, F.lit(HINTS[kind]))
        hits = F.filter(spans(F.when(hint, text).otherwise(""), F.lit(PATTERNS[kind])), lambda s: _good(kind, s["hit"]))
        return F.transform(hits, lambda s: make(i, kind, s))

    return F.flatten(F.array(*[of(i, k) for i, k in enumerate(KINDS)]))


def base_spans(text: Column) -> Column:
    """Personal data by kind as listed, then start: array<struct<start, end, order, kind>>."""
    return _found(text, lambda i, kind, s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(i).alias("order"), F.lit(kind).alias("kind")))


def entities(text: Column) -> Column:
    """The protected entities, told apart by a hash of the address or of the digits: array<struct<kind, value>>."""
    def entity(_, kind, s):
        same = {"email": F.lower, "ip": lambda h: h}.get(kind, lambda h: F.regexp_replace(h, "[^0-9]", ""))
        return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), same(s["hit"])).alias("value"))

    return F.array_distinct(_found(text, entity))


def _outside(text: Column) -> Column:
    """The text with its personal data blanked: what is left may still reveal it."""
    for k in KINDS:
        text = F.regexp_replace(text, F.lit(PATTERNS[k]), F.lit(" "))
    return text


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """_hash, _size, _terms, _targets of every different text: a target is an entity, or (kind, 0) for its kind.

    Copies are no evidence of their own, so equal texts (64-bit hash and length) count once.
    """
    rows = docs.select(text_of(text_col).alias("_text")).where("_text <> ''")
    held = rows.select("_text", F.inline(F.array(F.struct(entities(F.col("_text")).alias("_entities")))))
    kinds = F.array_distinct(F.transform("_entities", lambda e: F.struct(e["kind"].alias("kind"), F.lit(0).cast("bigint").alias("value"))))
    terms = _terms(F.when(F.size("_entities") > 0, _outside(F.col("_text"))).otherwise(F.col("_text")))
    # Terms hold no blanks: joined to one string they travel in half the space of an array.
    single = held.select(
        F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_size"), F.array_join(terms, " ").alias("_terms"),
        F.concat(kinds, "_entities").alias("_targets")).dropDuplicates(["_hash", "_size"])
    return single.withColumn("_terms", F.when(F.col("_terms") != "", F.split("_terms", " ")).otherwise(F.array().cast("array<string>")))


def _held_targets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The targets of two texts or more with their count, and the texts that hold one with their terms and such targets."""
    long = texts.select("_hash", "_size", F.explode("_targets").alias("t")).select("_hash", "_size", "t.*")
    targets = saved(long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("of_target")).where("of_target >= 2"), "pii-targets")
    lists = join_unique(long, targets.select("kind", "value"), ["kind", "value"], "inner").groupBy("_hash", "_size").agg(
        F.collect_list(F.struct("kind", "value")).alias("_held"))
    holders = texts.where(F.size("_targets") > 0).select("_hash", "_size", "_terms")
    return targets, saved(holders.join(lists, ["_hash", "_size"]), "pii-held", "zstd")


def _pairs(held: DataFrame) -> DataFrame:
    """(text, term, target) rows; one generator after the other, so that no task holds a text's pairs."""
    by_target = held.select("_hash", "_size", "_terms", F.explode("_held").alias("t"))
    return by_target.select("_hash", "_size", "t.kind", "t.value", F.explode("_terms").alias("term"))


def _telling(texts: DataFrame, targets: DataFrame, held: DataFrame, alpha: float, generalise: float, remove: float) -> DataFrame:
    terms = saved(texts.select(F.explode("_terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("of_term")).where("of_term >= 2"), "pii-df")
    pairs = saved(_pairs(held).groupBy("term", "kind", "value").agg(F.count(F.lit(1)).alias("both")).where("both >= 2"), "pii-pairs")
    n, tests = texts.count(), terms.count() * targets.count()
    of_term, of_target, both = (F.col(c).cast("double") for c in ("of_term", "of_target", "both"))
    p, seen = of_target / n, both / of_term
    information, pmi = -F.log(p), F.log(seen / p)
    # Chernoff's bound on the chance of so many joint texts among independent ones.
    rest = F.when(seen < 1, (1 - seen) * F.log((1 - seen) / (1 - p))).otherwise(0.0)
    evidence = of_term * (seen * pmi + rest)
    known = join_unique(join_unique(pairs, terms, "term", "inner"), targets.where(F.col("of_target") < n), ["kind", "value"], "inner")
    return (
        known.withColumn("share", pmi / information)
        .where((F.col("share") >= generalise) & (evidence >= math.log(max(tests, 1) / alpha)))
        .select("term", "kind", "value", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("level"),
                ((F.col("value") != 0) & (2 * F.col("both") >= F.col("of_term"))).alias("certain"))
    )


def disclosing_terms(docs: DataFrame, text_col="text", alpha=0.05, generalise=0.5, remove=0.8) -> DataFrame:
    """term, kind, value, level, certain: terms whose co-occurrence with a protected entity, or a kind, tells too much of it.

    Targets are the entities themselves (``value`` is their hash: one address, one number) and the four kinds
    (``value`` 0).  Over all different texts, p(target | term) and p(target) give the information that the term
    carries about the target, PMI = log p(target | term) - log p(target), out of the target's own
    IC = -log p(target).  From ``generalise`` of it a term is generalised, from ``remove`` of it removed, if the
    joint texts are significant: Chernoff's bound stays below ``alpha`` divided by the number of (term, target)
    tests.  A single text shows no co-occurrence.  A term is ``certain`` of an entity that half of its texts hold.
    """
    texts = saved(_texts(docs, text_col), "pii-texts", "zstd")
    return _telling(texts, *_held_targets(texts), alpha, generalise, remove)


def find_private(docs: DataFrame, text_col="text", alpha=0.05, generalise=0.5, remove=0.8) -> DataFrame:
    """``docs`` with spans: array<struct<start, end, order, kind>>, base kinds first, then term:generalise and term:remove.

    A telling term is marked in every document that holds the entity or kind it tells; a term that is certain
    of an entity also in all others, where the entity is absent or spelled differently.  A term with several levels
    takes the stronger one.  Null and empty texts have no spans, whatever their ids; repeated rows get the same
    spans; an empty table gives no rows; columns named like the results are replaced.
    """
    texts = saved(_texts(docs, text_col), "pii-texts", "zstd")
    released(docs.sparkSession)
    targets, held = _held_targets(texts)
    telling = saved(_telling(texts, targets, held, alpha, generalise, remove), "pii-terms")
    certain = telling.where("certain").groupBy("term").agg(F.max("level").alias("level"))
    words = texts.select("_hash", "_size", F.explode("_terms").alias("term"))
    marks = join_unique(words, certain, "term", "inner").unionByName(join_unique(
        _pairs(held), telling.drop("certain"), ["term", "kind", "value"], "inner").drop("kind", "value"))
    per_text = saved(
        marks.groupBy("_hash", "_size", "term").agg(F.max("level").alias("level"))
        .groupBy("_hash", "_size").agg(F.collect_list(F.struct("term", "level")).alias("_telling")), "pii-found")
    for step in (texts, held):
        dropped(step)
    released(docs.sparkSession)
    t = text_of(text_col)
    kept = without(docs, "spans", "_text", "_hash", "_size", "_base", "_telling").withColumns({"_hash": F.xxhash64(t), "_size": F.length(t)})
    met = join_unique(kept, per_text, ["_hash", "_size"], "left", source=kept.select("_hash", "_size")).drop("_hash", "_size").withColumn("_text", t)
    found = met.select("*", F.inline(F.array(F.struct(base_spans(F.col("_text")).alias("_base")))))
    levels = F.map_from_entries("_telling")
    inside = lambda s: F.exists("_base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    words = let(F.transform("_telling", lambda x: x["term"]), lambda terms: F.filter(
        F.transform(spans(F.col("_text"), F.lit(TERM)), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lower(s["hit"]).alias("term"))),
        lambda s: F.array_contains(terms, s["term"])))
    added = let(levels, lambda m: F.transform(F.filter(words, lambda s: ~inside(s)), lambda s: let(
        F.element_at(m, s["term"]), lambda level: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.when(level == "remove", len(KINDS) + 1).otherwise(len(KINDS)).alias("order"),
            F.concat(F.lit("term-"), level).alias("kind")))))
    extra = F.when(F.col("_telling").isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(
        F.array_sort(added, lambda a, b: F.when(a["order"] != b["order"], a["order"] - b["order"]).otherwise(
            F.signum(a["start"] - b["start"]).cast("int"))))
    return found.withColumn("spans", F.concat("_base", extra)).drop("_telling", "_text", "_base")


def sanitize(docs: DataFrame, text_col="text", **thresholds) -> DataFrame:
    """``find_private`` and sanitized: base kinds become [EMAIL], [IP], ..., generalised terms [TERM], removed terms go.

    Overlapping spans are replaced once, by the first in the text (the longest of those with one start).
    """
    found = find_private(docs, text_col, **thresholds)
    t = text_of(text_col)
    by_place = F.array_sort(F.col("spans"), lambda a, b: F.when(
        a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int")))
    mask = lambda s: F.when(s["kind"] == "term-remove", "").when(
        s["kind"] == "term-generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate(
        by_place, state,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"), F.concat(a["parts"], F.array(
                F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), mask(s))).alias("parts"))),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    return without(found, "sanitized").withColumn("sanitized", F.when(F.size("spans") == 0, t).otherwise(folded))


def digest() -> dict:
    """The contract's columns over ``spans``."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return {f"n_{k}": count(k) for k in KINDS} | {
        "base_sha256": F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(*KINDS))), 256),
        "_spans": span_text(F.col("spans")),
    }
