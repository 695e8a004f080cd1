"""Corpus-wide operators: SQL twins on the smallest tables, hand-made cases, and the pipeline stage by stage."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from check import compare, connect
from dqflow.llm import near
from dqflow.llm.decontaminate import decontaminate
from dqflow.llm.mixing import mix_sources
from dqflow.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(name, spark, con, sf):
    status, _, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert status == "ok", note


def test_ten_queries_and_the_pipeline():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def jaccard(a, b):
    def cut(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x and y else 0


def copies():
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    out = [" ".join(base)] * 3
    for _ in range(40):
        w = list(base)
        for i in rng.integers(0, 120, 2):
            w[i] = f"z{rng.integers(0, 10 ** 6)}"
        out.append(" ".join(w))
    chain = [f"c{i}" for i in range(60)]
    out += [" ".join(chain[i:] + [f"d{j}" for j in range(i)]) for i in range(0, 30, 3)]
    return [*out, None, "", "", "one two", "one  two", "one two three", "x " * 30_000, "x " * 20_000, *[" ".join(f"r{i}{j}" for j in range(30)) for i in range(9)]]


def test_classes_and_links_against_all_pairs(make_docs, monkeypatch):
    texts = copies()
    n = len(texts)
    linked = [[j for j in range(n) if j != i and jaccard(texts[i], texts[j]) >= 0.8] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in linked[i]]]) for i in range(n)]
    want = {i: (label[i], len(linked[i])) for i in range(n)}
    for block, small in ((256, 16), (8, 2)):
        monkeypatch.setattr(near, "BLOCK", block)
        monkeypatch.setattr(near, "SMALL_BUCKET", small)
        got = {r["_id"]: (r["class_id"], r["n_links"]) for r in near.near_classes(make_docs(texts).withColumn("NODE", F.lit(1))).collect()}
        assert got == want
    kept = near.keep_one(make_docs(texts).union(make_docs(texts[:2])))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_near_with_null_ids_and_no_rows(make_docs):
    df = make_docs(["a b c d e f"] * 3 + ["q r s t u v", None]).withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = near.near_classes(df).collect()
    assert sorted(r["n_links"] for r in rows) == [0, 0, 2, 2, 2] and {r["class_id"] for r in rows} == {None}
    assert near.near_classes(make_docs([])).count() == 0 and near.keep_one(make_docs([])).count() == 0


def test_keep_one_with_null_and_repeated_ids(make_docs):
    base = [f"w{i}" for i in range(80)]
    near_copies = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:]])]
    other = [" ".join(f"v{i}" for i in range(60)), None, ""]
    for ids in ([None] * 6, [7] * 6, [None, 3, None, None, 4, None], [5, 5, 2, None, None, 9]):
        df = make_docs(near_copies + other)
        wanted = F.element_at(F.array(*[F.lit(i).cast("bigint") for i in ids]), (F.col("doc_id") + 1).cast("int"))
        kept = near.keep_one(df.withColumn("doc_id", wanted).withColumn("LABEL", F.lit(1))).collect()
        copies = [r for r in kept if r["text"] in near_copies]
        assert len(copies) == 1 and sum(r["text"] == other[0] for r in kept) == 1
        known = [i for i in ids[:3] if i is not None]
        assert copies[0]["doc_id"] == (min(known) if known else None) and any(not r["text"] for r in kept)


def test_pruning_keeps_what_may_reach_the_threshold():
    need = near.least_matches()
    assert need[0] == 0 and all(a <= b for a, b in zip(need, need[1:])) and 0.6 < need[near.HASHES] / near.HASHES < 0.8


def test_decontamination_by_hand(spark, make_docs):
    words = [f"w{i}" for i in range(30)]
    docs = [None, "", " ".join(words), " ".join(words[:9]), "x " + " ".join(words[3:13]).upper() + " y " + "Short,item", "short item short item", "é1" * 40_000, "été été"]
    items = [(1, " ".join(words)), (2, "short-item"), (3, None), (4, "..."), (None, "ÉTÉ été"), (6, " ".join(words[:12])), (7, "short item")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (2_000_000, 5):
        rows = decontaminate(make_docs(docs).withColumn("N_HIT", F.lit(1)), bench, block_words=block).orderBy("doc_id").collect()
        got = [(r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows]
        assert got == [(0, 0, 0, False), (0, 0, 0, False), (30, 30, 2, True), (9, 0, 0, False), (14, 12, 3, True), (4, 4, 2, True), (1, 0, 0, False), (2, 0, 0, False)]
        assert rows[5]["items_sha256"] == brute.sha("2,7")
        assert [(s["start"], s["end"]) for s in rows[4]["hits"]] == [(1, 11), (12, 14)]
    assert decontaminate(make_docs(docs), bench.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontaminate(make_docs([]), bench).count() == 0


def test_mix_by_hand(spark, make_docs):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (20, "a"), (30, "b"), (40, "c"), (5, "d"), (0, "e"), (60, None), (7, None)])]
    rows += [(9, None, "a"), (None, "w w", "b"), (3, "w " * 40, "c"), (3, "w " * 40, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("TARGET", F.lit(1))
    for per in (1, 5_000):
        got = mix_sources(df, rows_per_slice=per).collect()
        assert len(got) == len(rows)
        total = sum(len((t or "").split()) for _, t, _ in rows)
        by = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
            assert 0 <= r["taken"] <= 3 * r["size"]
        # Iterated sharing: capped sources leave, the others share what remains by weight.
        names = sorted(k for k in by if k is not None) + [None]
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        size = {s: sum(r["size"] for r in by[s]) for s in names}
        want, free = {}, set(names)
        while True:
            left = total - sum(want.values())
            part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if part[s] > 3 * size[s]]
            if not over:
                want |= part
                break
            want |= {s: 3 * size[s] for s in over}
            free -= set(over)
        for s in names:
            assert by[s][0]["target"] == pytest.approx(want[s])
            assert sum(r["taken"] for r in by[s]) == pytest.approx(want[s], abs=0.51)
    assert mix_sources(df.limit(0)).count() == 0


def test_mix_without_ids_takes_whatever_the_hash_says(make_docs):
    """Rows without ids or with one id are drawn by their text's hash, not by size, and alike on every run."""
    texts = ["w " * (i % 40 + 1) + f"t{i}" for i in range(400)]
    for some_id in (F.lit(None).cast("bigint"), F.lit(5).cast("bigint")):
        df = make_docs(texts).withColumn("doc_id", some_id).withColumn("source", F.lit("a"))
        runs = [{r["text"]: (r["size"], r["taken"]) for r in mix_sources(df.repartition(n), share=0.5, rows_per_slice=20).collect()} for n in (1, 5)]
        assert runs[0] == runs[1]
        taken = [size for size, t in runs[0].values() if t]
        left = [size for size, t in runs[0].values() if not t]
        assert 130 < len(taken) < 270 and min(left) < 10 and max(taken) > 32


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = stages["quality rules"](spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in good.collect()}
    base = {i for i, t in rows.items() if (q := brute.quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert kept <= base and {i for i in base if labels.get(i) == 1} <= kept and good.columns == docs.columns

    single = stages["near duplicates"](spark, good, sf_dir).cache()
    ids = {r["doc_id"] for r in single.collect()}
    classes = {r["_id"]: r["class_id"] for r in near.near_classes(good).collect()}
    assert ids == set(classes.values()) and single.columns == docs.columns

    clean = stages["benchmark decontamination"](spark, single, sf_dir).cache()
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = brute.words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))}

    def leaks(t):
        w = brute.words(t)
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w)))
    assert {r["doc_id"] for r in clean.collect()} == {i for i in ids if not leaks(rows[i])} and clean.columns == docs.columns

    private = stages["personal data"](spark, clean, sf_dir).cache()
    assert private.count() == clean.count() and private.columns == docs.columns
    for r in private.collect():
        assert brute.personal(r["text"])[:4] == (0, 0, 0, 0) and r["n_chars"] == len(r["text"])
        if brute.personal(rows[r["doc_id"]])[:4] == (0, 0, 0, 0):
            assert r["text"] == rows[r["doc_id"]]

    mixed = stages["source mix"](spark, private, sf_dir)
    by = Counter()
    for r in mixed.collect():
        assert 0 < r["taken"] <= 3 * r["size"]
        by[r["source"], round(r["target"])] += r["taken"]
    assert all(n == target for (_, target), n in by.items())
