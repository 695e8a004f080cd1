"""Operator 7: secret scan through a trigram inverted index."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import let, span_text, spans, text_of, without

#: (kind, pattern whose first group is measured, least length): the base kinds of the contract in their order.
#: Runs of one class are matched whole, so a least length inside the pattern drops the same matches.
BASE_RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"(AKIA[A-Z0-9]{14,})", 18),
    ("hex", r"([0-9a-f]{16,})", 16),
)
#: Kinds that the method adds.
MORE_RULES = (
    ("git-token", r"(gh[pousr]_[A-Za-z0-9]{36,})", 40),
    ("git-pat", r"(github_pat_[A-Za-z0-9_]{22,})", 33),
    ("lab-token", r"(glpat-[A-Za-z0-9_-]{20,})", 26),
    ("chat-token", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 15),
    ("payment-key", r"((?:sk|rk|pk)_live_[A-Za-z0-9]{16,})", 24),
    ("maps-key", r"(AIza[A-Za-z0-9_-]{35})", 39),
    ("mail-key", r"(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})", 69),
    ("web-token", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 32),
    ("private-key", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----)", 27),
    ("package-token", r"(npm_[A-Za-z0-9]{36})", 40),
    ("index-token", r"(pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,})", 69),
    ("bearer", r"""(?i:authorization)["']?\x20*[:=]\x20*["']?(?i:bearer)\x20+([A-Za-z0-9+/_.=-]{16,})""", 16),
    ("url-login", r"(?i:https?|ftp|ssh|postgres|mysql|mongodb)://[A-Za-z0-9._~%-]+:([^\x00-\x20@/:]{6,})@", 6),
)
RULES = BASE_RULES + MORE_RULES
GAP = "\0"
MOST_BRANCHES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The pattern's Boolean query: any of the returned sets must occur whole; None where no trigram is mandatory.

    Literals are spelled out, alternatives and optional characters multiply the spellings, and everything
    else becomes a gap.  Trigrams are lower-cased, as the index is.
    """
    from re import _constants as op
    from re import _parser as parser

    def spell(items):
        out = [""]
        for kind, value in items:
            if kind is op.LITERAL:
                more = [chr(value).lower()]
            elif kind is op.SUBPATTERN:
                more = spell(value[-1])
            elif kind is op.BRANCH:
                more = [s for branch in value[1] for s in spell(branch)]
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                low, high, inner = value
                once = spell(inner)
                more = [*([""] if high == 1 else [GAP]), *once] if low == 0 else [s + GAP for s in once]
            elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
                more = [""]
            else:
                more = [GAP]
            more = list(dict.fromkeys(more))
            out = [a + b for a in out for b in more] if len(out) * len(more) <= MOST_BRANCHES else [a + GAP for a in out]
        return out

    clauses = {frozenset(p[i:i + 3] for p in s.split(GAP) for i in range(len(p) - 2)) for s in spell(parser.parse(pattern))}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """The inverted index over the trigrams that rules ask for: trigram, id and text hash."""
    found = let(F.lower(text_of(text_col)), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_hash"), F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, id_col: str, text_col: str, rules=RULES) -> DataFrame:
    """_id, _hash (of the text) and the set of indexed rules whose query their postings satisfy."""
    spark = docs.sparkSession
    queries = {kind: trigram_query(p) for kind, p, _ in rules}
    rows = [(kind, i, g, len(c)) for kind, q in queries.items() if q for i, c in enumerate(q) for g in sorted(c)]
    if not rows:
        return spark.createDataFrame([], "_id string, _hash bigint, _rules array<string>").select(
            F.col("_id").cast(dict(docs.dtypes)[id_col]), "_hash", "_rules")
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    lists = postings(docs, id_col, text_col, sorted({r[2] for r in rows}))
    # The clause table has one row per trigram of a rule, whatever the size of the input.
    # A text lists each trigram once; rows alike in id and text may meet a clause together, which verification sorts out.
    met = (
        lists.join(F.broadcast(clauses), "trigram").groupBy("_id", "_hash", "kind", "clause", "need")
        .agg(F.count(F.lit(1)).alias("n")).where("n >= need")
    )
    return met.groupBy("_id", "_hash").agg(F.collect_set("kind").alias("_rules"))


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", rules=RULES, base=tuple(r[0] for r in BASE_RULES)) -> DataFrame:
    """``docs`` with spans: array<struct<start, order, end, kind, part>> by start, then the order of the rules.

    Candidates come from intersected postings; rules without a mandatory trigram (runs of one character class)
    scan every text.  Candidates are verified with the pattern on the whole text.  A null text has no spans.
    Rows meet their candidates by id and text hash, so null and repeated ids spread over tasks; rows alike in both
    share candidates.  Every row is verified on its own text.
    An empty table gives no rows; columns named like the results are replaced.
    """
    open_rules = [r[0] for r in rules if trigram_query(r[1]) is None]
    table = F.from_json(F.lit(json.dumps([
        {"order": i, "kind": k, "regex": p, "least": n} for i, (k, p, n) in enumerate(rules)])),
        "array<struct<order:int,kind:string,regex:string,least:int>>")
    # A shuffled hash join needs no sort of the texts; per partition it holds the candidates only.
    hits = candidates(docs, id_col, text_col, rules).hint("shuffle_hash")
    kept = without(docs, "spans", "_id", "_hash", "_rules")
    same = kept[id_col].eqNullSafe(hits["_id"]) & (F.xxhash64(text_of(kept[text_col])) == hits["_hash"])
    joined = kept.join(hits, same, "left").drop("_id", "_hash")
    active = F.concat(F.coalesce("_rules", F.array().cast("array<string>")), F.array(*map(F.lit, open_rules)).cast("array<string>"))

    def of(r):
        found = F.filter(spans(text_of(text_col), r["regex"], 1), lambda s: F.length(s["part"]) >= r["least"])
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), r["order"].alias("order"), s["end"].alias("end"), r["kind"].alias("kind"), s["part"].alias("part")))

    every = F.flatten(F.transform(
        let(active, lambda a: F.filter(table, lambda r: F.array_contains(a, r["kind"]))), of))
    return joined.select("*", F.inline(F.array(F.struct(F.array_sort(every).alias("spans"))))).drop("_rules")


def digest(scanned: DataFrame) -> dict:
    """The contract's columns over ``spans``."""
    def is_base(s):
        return s["kind"].isin(*[r[0] for r in BASE_RULES])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return {f"n_{r[0]}": count(r[0]) for r in BASE_RULES} | {
        "base_sha256": F.sha2(span_text(F.filter("spans", is_base)), 256),
        "_spans": span_text(F.col("spans")),
    }
