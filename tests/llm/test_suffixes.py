"""Repeated strings against a plain count of all windows."""

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqflow.llm import suffixes


def brute(texts, span=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - span + 1):
            if seen[d[i:i + span]] > 1:
                hit[i:i + span] = True
        spans = int(np.sum(hit[:-1] & ~np.concatenate([[False], hit[:-1]])[: len(d)])) if len(d) else 0
        kept = bytes(b for b, h in zip(d, hit) if not h)
        out.append((len(d), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **kw):
    return {r["_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.drop_repeats(df, **kw).collect()}


def prose(rng, n):
    return "".join(rng.choice(list("etaoin shrdlu\n"), n))


def hard():
    rng = np.random.default_rng(5)
    part, copy = prose(rng, 400), prose(rng, 900)
    return [
        None, "", "short", copy, copy, prose(rng, 250) + part + prose(rng, 80), part[:201] + prose(rng, 300), prose(rng, 50) + part[150:], part[:199],
        "Ti " * 2000, "Ti " * 70 + prose(rng, 40), "é" * 150, "é" * 100, prose(rng, 199), "x" * 200, "x" * 199 + "y", prose(rng, 300) * 2,
        "a" + "\x00" * 450 + "b", prose(rng, 210) + "\x00" * 205, "ab" * 99 + "cd" + "ab" * 99, *[prose(rng, 120) + part[:260] + prose(rng, 130) for _ in range(6)],
    ]


def test_contract(documents, make_docs):
    rows = documents.orderBy("doc_id").collect()
    assert result(documents) == {r["doc_id"]: x for r, x in zip(rows, brute([r["text"] for r in rows]))}
    texts = hard()
    want = dict(enumerate(brute(texts)))
    assert result(make_docs(texts).withColumn("KEY", F.lit(1)).withColumn("h", F.lit(2))) == want
    assert result(make_docs(texts), hot_blocks=1) == want
    assert result(make_docs([])) == {}


def test_null_and_repeated_ids(make_docs):
    texts = hard()
    want = sorted(brute(texts))
    for i in (None, 1):
        got = suffixes.drop_repeats(make_docs(texts).withColumn("doc_id", F.lit(i).cast("bigint"))).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00c", min_size=8, max_size=60), min_size=1, max_size=6))
def test_two_stage_order(parts):
    data = "".join(parts).encode()
    t = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    wanted = np.arange(0, len(data) - 7)[::2]
    order = suffixes.two_stage_order(t, wanted, 8)
    assert sorted(order.tolist()) == wanted.tolist()
    cut = [data[i:i + 8] for i in order]
    assert cut == sorted(cut)
