"""Personal data against plain Python; disclosure against hand-made counts."""

from pyspark.sql import functions as F

import brute
from dqflow.llm.pii import digest, disclosing_terms, find_private, sanitize

HARD = [
    None, "", "a@b.c x@y a.b+c@d-e.f.g_x@y.zz @q.r", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.002.3.255 999.1.1.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111000 12 3456", "+1 (988) 555-2485 +12 +1234567 +1-2-3-4-5-6-7-8 +44.20.7946.0958)) x",
    "é𝕏 mail: me@é.com me@x.com, 𝕏 10.0.0.1", "a" * 50_000 + "@x.y " + "b" * 50_000, "1" * 40_000 + " " + "1 " * 20_000, "+1" + " " * 60_000,
    "x@" + "a." * 20_000 + "b", "a@b.cc@d.e", "4111 1111 1111 1111" * 3, "1.1.1.1@2.2.2.2 +1.2.3.4.5.6.7.8",
]


def rows_of(df, **kw):
    return find_private(df, **kw).withColumns(digest()).collect()


def test_base_spans(documents, make_docs):
    hard = make_docs(HARD)
    for df in (documents, hard, hard.withColumn("doc_id", F.lit(None).cast("bigint")), hard.withColumn("Spans", F.lit(1)).withColumn("kind", F.lit(2))):
        rows = rows_of(df)
        assert len(rows) == df.count()
        for r in rows:
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.personal(r["text"]), r["text"][:80]
    assert rows_of(hard.limit(0)) == []
    assert disclosing_terms(hard.limit(0)).count() == 0


def crowd():
    """30 texts with a mail address share a telltale word, 30 others have none of it; 'often' leans to mails."""
    with_mail = [f"contact zebra often {i} me{i}@x.org" for i in range(30)]
    return with_mail + [f"plain text {i} " + ("often" if i < 6 else "never") for i in range(30)] + ["zebra without"]


def test_disclosing_terms(make_docs):
    docs = make_docs(crowd() * 2)  # copies are no further evidence
    rows = find_private(docs, generalise=0.3, remove=0.99).orderBy("doc_id").collect()
    kinds = [[s["kind"] for s in r["spans"]] for r in rows]
    # p(mail | contact) = 1: all of the information; zebra 30 of 31; often 30 of 36.
    assert kinds[0] == ["email", "term-generalise", "term-generalise", "term-remove"]
    assert [rows[0]["text"][s["start"]:s["end"]] for s in rows[0]["spans"][1:]] == ["zebra", "often", "contact"]
    # Terms of a kind tell nothing where no data of that kind stand.
    assert all(k == [] for k in kinds[30:61])
    terms = {(r["term"], r["level"]) for r in disclosing_terms(docs, generalise=0.3, remove=0.99).collect()}
    assert terms == {("contact", "remove"), ("zebra", "generalise"), ("often", "generalise")}


def test_a_name_beside_one_address_is_removed_everywhere(make_docs):
    """Five texts hold a name and its address among 70 with other addresses; the name alone reveals the address."""
    named = [f"ask Quillon about part{i} at Ann@x.org" for i in range(3)] + [f"ask quillon about part{i} at ann@X.org" for i in range(3, 5)]
    others = [f"ask someone about thing{i} at me{i}@x.org" for i in range(70)] + [f"ask someone about part{i} at noon" for i in range(70)]
    alone = ["Quillon writes from ann at x dot org", "quillonite is a stone", "ask about it"]
    rows = sanitize(make_docs(named + others + alone)).orderBy("doc_id").collect()
    assert rows[0]["sanitized"] == "ask  about part0 at [EMAIL]" and rows[4]["sanitized"] == "ask  about part4 at [EMAIL]"
    assert [r["sanitized"] for r in rows[145:]] == [" writes from ann at x dot org", "quillonite is a stone", "ask about it"]
    assert [r["sanitized"] for r in rows[75:145]] == [r["text"] for r in rows[75:145]]


def test_terms_against_plain_counts(documents, make_docs):
    """PMI and significance of every (term, target) pair, counted in plain Python."""
    import math
    import random
    import re

    rnd = random.Random(7)
    mails = [f"p{i}@mail.org" for i in range(6)]
    texts = []
    for i in range(400):
        words = rnd.choices([f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"], weights=range(1, 27), k=8)
        who = rnd.randrange(12)
        texts.append(" ".join(words + ([mails[who], "name" + "xyzuvt"[who], rnd.choice(["mailto", "note"])] if who < 6 else ["note"] * (who % 2)) + ["k" + "abcdefgh"[i % 8] * (1 + i // 8)]))
    texts += texts[:100]
    alone = set(texts)
    term, joint, target = {}, {}, {}
    for t in alone:
        held = {("email", m) for m in mails if m in t}
        held |= {("email", "") for _ in held}
        rest = t
        for m in mails:
            rest = rest.replace(m, " ")
        names = set(re.findall(r"[^\W\d_]+", rest.lower()))
        for n in names:
            term[n] = term.get(n, 0) + 1
            for h in held:
                joint[n, h] = joint.get((n, h), 0) + 1
        for h in held:
            target[h] = target.get(h, 0) + 1
    n, want = len(alone), set()
    limit = math.log(sum(c >= 2 for c in term.values()) * sum(c >= 2 for c in target.values()) / 0.05)
    for (word, h), k in joint.items():
        p, a = target[h] / n, k / term[word]
        share = math.log(a / p) / -math.log(p)
        kl = a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0)
        if k >= 2 and share >= 0.5 and term[word] * kl >= limit:
            want.add((word, h[1] == "", "remove" if share >= 0.8 else "generalise", h[1] != "" and 2 * k >= term[word]))
    got = {(r["term"], r["value"] == 0, r["level"], r["certain"]) for r in disclosing_terms(make_docs(texts)).collect()}
    assert got == want and {w for w, *_ in want} >= {"namex", "mailto"}


def test_sanitized_text(make_docs):
    rows = sanitize(make_docs(crowd()), generalise=0.3, remove=0.99).orderBy("doc_id").collect()
    assert rows[0]["sanitized"] == " [TERM] [TERM] 0 [EMAIL]"
    assert rows[40]["sanitized"] == rows[40]["text"]
    assert [r["sanitized"] for r in sanitize(make_docs([None, "𝕏 10.0.0.1 é"])).orderBy("doc_id").collect()] == ["", "𝕏 [IP] é"]
