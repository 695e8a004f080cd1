"""Operator 8: license scan by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import SEPARATORS, let, spans, text_of, without
from dqflow.llm.signatures import SIGNATURES, SPDX, mandatory_words

WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
START, STOP = rf"(?<![{WORD_CHARS}])", rf"(?![{WORD_CHARS}])"

#: Phrases and labels of the query's contract.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: (label, SPDX identifier, keywords, name pattern; a blank stands for any separators).  Keywords are whole words
#: (or choices of them); each keyword's choice stands in every match of the pattern, with any separators around it.
NAMES = (
    ("gpl-1.0", "GPL-1.0", ("general", "public"), r"(?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("gpl-2.0", "GPL-2.0", ("general", "public"), r"(?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "GPL-3.0", ("general", "public"), r"(?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("gpl-2.0", "GPL-2.0-only", ("gplv2",), r"gplv2"),
    ("gpl-3.0", "GPL-3.0-only", ("gplv3",), r"gplv3"),
    ("lgpl-2.1", "LGPL-2.1", ("lesser", "general"), r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1"),
    ("lgpl-3.0", "LGPL-3.0", ("lesser", "general"), r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?"),
    ("lgpl-2.0", "LGPL-2.0", ("library", "general"), r"(?:gnu )?library general public licen[cs]e"),
    ("agpl-3.0", "AGPL-3.0", ("affero",), r"(?:gnu )?affero general public licen[cs]e"),
    ("gfdl-1.3", "GFDL-1.3", ("free", "documentation"), r"(?:gnu )?free documentation licen[cs]e"),
    ("apache-1.1", "Apache-1.1", ("apache", "licence|license"), r"apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    ("apache-2.0", "Apache-2.0", ("apache", "licence|license"), r"apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    ("mit", "MIT", ("mit", "licence|license"), r"(?:the )?mit licen[cs]e"),
    ("mit-0", "MIT-0", ("mit", "attribution"), r"mit no attribution"),
    ("x11", "X11", ("x11",), r"x11 licen[cs]e"),
    ("isc", "ISC", ("isc", "licence|license"), r"isc licen[cs]e"),
    ("bsd-2-clause", "BSD-2-Clause", ("bsd",), r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "BSD-3-Clause", ("bsd",), r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "BSD-4-Clause", ("bsd",), r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("0bsd", "0BSD", ("zero", "bsd"), r"zero clause bsd(?: licen[cs]e)?"),
    ("cc0-1.0", "CC0-1.0", ("cc0",), r"(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by-2.0", "CC-BY-2.0", ("cc|commons", "by", "2"), r"(?:creative commons |cc )by 2 0"),
    ("cc-by-3.0", "CC-BY-3.0", ("cc|commons", "by", "3"), r"(?:creative commons |cc )by 3 0"),
    ("cc-by-4.0", "CC-BY-4.0", ("cc|commons", "by", "4"), r"(?:creative commons |cc )by 4 0"),
    ("cc-by-sa-3.0", "CC-BY-SA-3.0", ("cc|commons", "by", "sa", "3"), r"(?:creative commons |cc )by sa 3 0"),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", ("cc|commons", "by", "sa", "4"), r"(?:creative commons |cc )by sa 4 0"),
    ("cc-by-nc-3.0", "CC-BY-NC-3.0", ("cc|commons", "by", "nc", "3"), r"(?:creative commons |cc )by nc 3 0"),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0", ("cc|commons", "by", "nc", "4"), r"(?:creative commons |cc )by nc 4 0"),
    ("cc-by-nd-4.0", "CC-BY-ND-4.0", ("cc|commons", "by", "nd", "4"), r"(?:creative commons |cc )by nd 4 0"),
    ("cc-by-nc-sa-4.0", "CC-BY-NC-SA-4.0", ("cc|commons", "by", "nc", "sa"), r"(?:creative commons |cc )by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "CC-BY-NC-ND-4.0", ("cc|commons", "by", "nc", "nd"), r"(?:creative commons |cc )by nc nd 4 0"),
    ("cc-by", "CC-BY", ("attribution", "creative", "commons"), r"creative commons attribution(?: licen[cs]e)?"),
    ("mpl-1.1", "MPL-1.1", ("mozilla", "public"), r"mozilla public licen[cs]e (?:version |v )?1 1"),
    ("mpl-2.0", "MPL-2.0", ("mozilla", "public"), r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("epl-1.0", "EPL-1.0", ("eclipse", "public"), r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    ("epl-2.0", "EPL-2.0", ("eclipse", "public"), r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    ("eupl-1.2", "EUPL-1.2", ("european", "union"), r"european union public licen[cs]e"),
    ("cddl-1.0", "CDDL-1.0", ("common", "development"), r"common development and distribution licen[cs]e"),
    ("bsl-1.0", "BSL-1.0", ("boost", "licence|license"), r"boost software licen[cs]e"),
    ("zlib", "Zlib", ("zlib", "licence|license"), r"zlib licen[cs]e"),
    ("unlicense", "Unlicense", ("unlicense",), r"(?:the )?unlicense"),
    ("wtfpl", "WTFPL", ("wtfpl",), r"wtfpl"),
    ("artistic-2.0", "Artistic-2.0", ("artistic", "licence|license"), r"artistic licen[cs]e(?: 2 0)?"),
    ("psf-2.0", "PSF-2.0", ("python", "software"), r"python software foundation licen[cs]e"),
    ("ofl-1.1", "OFL-1.1", ("open", "font"), r"(?:sil )?open font licen[cs]e"),
    ("odbl-1.0", "ODbL-1.0", ("open", "database"), r"open database licen[cs]e"),
    ("public-domain", "Public-Domain", ("public", "domain"), r"(?:in |into |to )?(?:the )?public domain"),
)

#: (priority, words before the name, words after it): a stated grant outweighs a name met in passing.
FRAMES = (
    (80, r"(?:is |are )?(?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?", ""),
    (75, r"subject to (?:the )?(?:terms of )?(?:the )?", ""),
    (60, "", r" (?:or any later version|or later)"),
    (50, "", ""),
)
TAG_PRIORITY = 100


def with_gaps(pattern: str) -> str:
    """Blanks stand for separators; a blank before ``?`` for separators that may be missing."""
    return pattern.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


def signature_rules(names=NAMES, frames=FRAMES, signatures=SIGNATURES, tags=SPDX) -> list[dict]:
    """The ordered rules: identifier tags, hand-written signatures, and one rule per name and frame."""
    out = [(TAG_PRIORITY, tag.lower(), ("spdx", "identifier"), r"spdx license identifier " + re.sub("[-.]", " ", tag.lower())) for tag in tags]
    out += [(priority, label, tuple(mandatory_words(pattern)), pattern) for priority, label, pattern in signatures]
    out += [(priority, label, keywords, before + pattern + after)
            for label, _, keywords, pattern in names for priority, before, after in frames]
    return [
        {"rank": i, "priority": p, "label": label, "words": list(words), "regex": START + "(?i:" + with_gaps(pattern) + ")" + STOP}
        for i, (p, label, words, pattern) in enumerate(sorted(out, key=lambda r: -r[0]))
    ]


def _detections(text: Column, rules: list[dict]) -> Column:
    """Spans of all rules whose keywords occur; array<struct<start, end, label, priority, rank>>."""
    kind = "array<struct<rank:int,priority:int,label:string,words:array<array<string>>,regex:string>>"
    table = F.from_json(F.lit(json.dumps([{**r, "words": [w.split("|") for w in r["words"]]} for r in rules])), kind)
    words = sorted({w for r in rules for choice in r["words"] for w in choice.split("|")})
    # The blank in front makes the first piece empty, so the word "" of a rule without keywords is always present.
    present = F.array_intersect(F.array(*map(F.lit, words)), F.split(F.concat(F.lit(" "), F.lower(text)), SEPARATORS))

    def of(r):
        return F.transform(spans(text, r["regex"]), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), r["label"].alias("label"),
            r["priority"].alias("priority"), r["rank"].alias("rank")))

    return let(present, lambda have: F.when(
        F.size(have) == 0, F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int,rank:int>>"),
    ).otherwise(F.flatten(F.transform(
        F.filter(table, lambda r: F.forall(r["words"], lambda w: F.arrays_overlap(have, w))), of))))


def _surviving(found: Column) -> Column:
    """Detections that no better one contains: higher priority, or equal and longer, or the same place and earlier rule."""
    def beaten(x, y):
        return (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & (
            (y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (
                (y["end"] - y["start"] > x["end"] - x["start"]) | ((y["end"] - y["start"] == x["end"] - x["start"]) & (y["rank"] < x["rank"])))))
    return let(found, lambda d: F.filter(d, lambda x: ~F.exists(d, lambda y: beaten(x, y))))


def scan_licenses(docs: DataFrame, text_col="text", rules: list[dict] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    The base phrases are counted on words; ``detections`` are the rules' surviving spans in code points and the
    score is the highest surviving priority over 100 (0.5 where only a base phrase occurs).  Row by row, without
    a shuffle.  Null and empty texts have no words and labels and score 0.  Repeated rows stay; columns named like
    the results are replaced; an empty table gives no rows.
    """
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    t = F.col("_text")
    base = without(docs.withColumn("_text", text_of(text_col)), *own)
    gate = let(F.lower(t), lambda s: F.contains(s, F.lit("license")) | (F.contains(s, F.lit("cc")) & F.contains(s, F.lit("by"))))

    def places_of(phrase, label):
        return F.transform(spans(t, F.lit(START + "(?i:" + phrase.replace(" ", GAP) + ")" + STOP)),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(label).alias("label")))

    places = F.flatten(F.array(*[places_of(*p) for p in PHRASES]))
    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def word_at(start):
        return F.regexp_count(F.substring(t, F.lit(1), start.cast("int")), F.lit(f"[{WORD_CHARS}]+")).cast("bigint")

    scanned = base.select("*", F.inline(F.array(F.struct(
        F.when(gate, places).otherwise(none).alias("_places"), _surviving(_detections(t, rules or signature_rules())).alias("detections")))))
    starts = F.transform("_places", lambda s: s["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("_places", lambda s: s["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda s: s["label"]))))
    best = F.array_max(F.transform("detections", lambda s: s["priority"])) / 100.0
    return scanned.withColumns({
        "n_words": F.regexp_count(t, F.lit(f"[{WORD_CHARS}]+")).cast("bigint"),
        "n_base": F.size("_places").cast("bigint"),
        "first_word": F.when(F.size("_places") > 0, word_at(F.array_min(starts))),
        "last_word": F.when(F.size("_places") > 0, word_at(F.array_max(starts))),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(every, ","),
        "score": F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("_places") > 0, 0.5).otherwise(0.0)),
    }).drop("_text", "_places")
