"""Language model: base score and forward recursion against plain Python, training against likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import ascii_lower
from dqflow.llm import hmm


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")), None]


def base_of(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(h, len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            for (_, t), h in zip(rows, held)]


@pytest.mark.parametrize("words,frequent", [(4000, 2_000_000), (20, 50)])
def test_base_score(documents, make_docs, words, frequent):
    hard = make_docs([None, "", "A a É é", "one", "word " * 30_000, *["x y z"] * 12]).unionByName(
        make_docs(["x y", None]).withColumn("doc_id", F.lit(None).cast("bigint")))
    for df in (documents, hard.withColumn("Score", F.lit(1)).withColumn("obs", F.lit(2))):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = sorted(base_of(rows), key=repr)
        got = sorted(((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                      for r in hmm.score_texts(df, words=words, frequent=frequent, steps=1).collect()), key=repr)
        for a, b in zip(sorted(got, key=lambda r: (r[:4], round(r[4], 3))), sorted(want, key=lambda r: (r[:4], round(r[4], 3)))):
            assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
        assert len(got) == len(want)
    assert hmm.score_texts(documents.limit(0)).count() == 0


def test_forward_and_expectations_match_enumeration():
    rng = np.random.default_rng(3)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    m = hmm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    sequences = [np.array(s, np.uint16) for s in ([0, 1, 2, 1], [2, 0, 1], [1])]
    total, _ = hmm.forward(sequences, m)
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    from itertools import product
    for s, got in zip(sequences, total):
        paths = {}
        for z in product(range(2), repeat=len(s)):
            p = m.start[z[0]] * m.emit[z[0], s[0]]
            for i in range(1, len(s)):
                p *= m.move[z[i - 1], z[i]] * m.emit[z[i], s[i]]
            paths[z] = p
        whole = sum(paths.values())
        assert got == pytest.approx(math.log10(whole))
        for z, p in paths.items():
            starts[z[0]] += p / whole
            for i, o in enumerate(s):
                emits[z[i], o] += p / whole
                if i:
                    moves[z[i - 1], z[i]] += p / whole
    got, _ = hmm.expectations(sequences, m)
    assert np.allclose(got.start, starts) and np.allclose(got.move, moves) and np.allclose(got.emit, emits)


def test_score_is_a_distribution(make_docs):
    """The probabilities of all texts of three tokens sum to one, unseen words taken together by shape."""
    from itertools import product

    rows = make_docs(["a b a c", "b a", "c c a", "dd e1"]).select(
        F.col("doc_id").alias("_id"), F.lit(False).alias("held_out"), F.col("text").alias("_t"))
    vocab = hmm.vocabulary(hmm.word_counts(rows, "_t"), 2, 1000)
    m, _ = hmm.train(hmm.encode(rows, "_t", vocab).cache(), vocab, 3, 3, 7)
    far = m.far.select(*hmm._names(3)).toPandas().to_numpy()
    far = m.scale[:, None] * (far + far.sum(axis=1, keepdims=True) / (vocab.tokens + 0.5)).T
    unseen = np.full((3, 1), 1 - vocab.seen)
    whole = hmm.Model(m.start, m.move, np.concatenate([m.emit[:, :vocab.size - hmm.SHAPES], far, unseen], axis=1))
    every = [np.array(s) for s in product(range(whole.emit.shape[1]), repeat=3)]
    assert (10 ** hmm.forward(every, whole)[0]).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(m.start.sum(), 1) and np.allclose(m.move.sum(axis=1), 1)


def test_workers_need_no_classes_of_the_package(make_docs, spark, monkeypatch):
    import pickle

    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or send(self, value))
    hmm.score_texts(make_docs(["a b", "b a", "c"]), steps=1).collect()
    assert sent and not any(b"dqflow" in x for x in sent)


def test_training_raises_the_likelihood_and_beats_counts_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("_id"), F.lit(False).alias("held_out"), F.col("text").alias("_t"))
    vocab = hmm.vocabulary(hmm.word_counts(rows, "_t"), 500, 10_000)
    coded = hmm.encode(rows, "_t", vocab).cache()
    _, history = hmm.train(coded, vocab, 4, 4, 7)
    assert all(b > a for a, b in zip(history, history[1:]))
    held = hmm.score_texts(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def test_every_training_word_has_emissions_of_its_own(make_docs):
    """Words without a code: each has expected counts that sum to its count, and words of one shape are told apart."""
    texts = ["ab cd ab cd", "ef gh ef gh", "ab cd ef gh", "cd ab zz", None, "xé ab"] * 3
    rows = make_docs(texts).select(F.col("doc_id").alias("_id"), F.lit(False).alias("held_out"), F.col("text").alias("_t"))
    counts = hmm.word_counts(rows, "_t")
    vocab = hmm.vocabulary(counts, 1, 1000)
    coded = hmm.encode(rows, "_t", vocab).cache()
    m, _ = hmm.train(coded, vocab, 2, 2, 7)
    got = {r["h"]: [r["x0"], r["x1"]] for r in m.far.collect()}
    want = {r["h"]: r["c"] for r in vocab.rest.collect()}
    assert got.keys() == want.keys() and all(sum(got[h]) == pytest.approx(want[h]) for h in want)
    shares = {round(got[h][0] / want[h], 6) for h in hmm._hash([b"cd", b"ef", b"gh"]).tolist() if h in got}
    assert len(shares) > 1
    whole = hmm.vocabulary(counts, 4000, 1000)
    assert whole.rest.count() == 0 and len(whole.coded_hashes) == 1 + counts.count() - 1
    few, at_hand = (sum(r["score"] for r in hmm.score_texts(make_docs(texts), words=w, steps=6).collect()) for w in (1, 4000))
    assert few == pytest.approx(at_hand, rel=0.1)


def test_training_ends_by_its_tolerance(make_docs, monkeypatch):
    monkeypatch.setattr(hmm, "START_STEPS", 1)
    rows = make_docs(["a b a b", "b a b a", "c d c d", "d c d c"] * 60).select(
        F.col("doc_id").alias("_id"), F.lit(False).alias("held_out"), F.col("text").alias("_t"))
    vocab = hmm.vocabulary(hmm.word_counts(rows, "_t"), 2, 1000)
    coded = hmm.encode(rows, "_t", vocab).cache()
    _, history = hmm.train(coded, vocab, 2, None, 7, tolerance=1e-2)
    gains = [(b - a) / abs(a) for a, b in zip(history, history[1:])]
    assert len(history) > 1 and gains[-1] < 1e-2 and all(g >= 1e-2 for g in gains[:-1])


def test_start_counts_the_neighbours_of_all_training_texts(make_docs, monkeypatch):
    """Every training text counts, however long or many, and no other: the start is not taken from a sample."""
    monkeypatch.setattr(hmm, "START_WORDS", 2)
    texts = ["a b a", "a b " * 5_000, "b zz", None, *["c d1 a"] * 300]
    rows = make_docs(texts).select(F.col("doc_id").alias("_id"), (F.col("doc_id") % 7 == 4).alias("held_out"), F.col("text").alias("_t"))
    vocab = hmm.vocabulary(hmm.word_counts(rows.where("not held_out"), "_t"), 4000, 1000)
    got = hmm.neighbours(hmm.encode(rows.repartition(3), "_t", vocab), vocab, 2)
    place = {h: i for i, h in enumerate(vocab.coded_hashes[:3].tolist())}
    of = lambda w: place.get(int(hmm._hash([w])[0]), 3 + hmm.shape_of(w))
    want = np.zeros((3 + hmm.SHAPES + 1, 3 + hmm.SHAPES))
    for i, t in enumerate(texts):
        if i % 7 != 4:
            line = [of(w) for w in hmm.tokens_of(t)]
            want[-1, line[0]] += 1
            for a, b in zip(line, line[1:]):
                want[a, b] += 1
    assert got.sum() == vocab.tokens and np.array_equal(got, want)


def test_start_tells_words_apart_by_their_neighbours(make_docs):
    """Words that keep to themselves come from different states at the start already."""
    rows = make_docs(["a b b a a b a b b", "x y y x x y x y y"] * 30).select(
        F.col("doc_id").alias("_id"), F.lit(False).alias("held_out"), F.col("text").alias("_t"))
    vocab = hmm.vocabulary(hmm.word_counts(rows, "_t"), 4000, 1000)
    begin = hmm.starting_point(hmm.encode(rows, "_t", vocab).cache(), vocab, 2, 7)
    share = dict(zip(begin.hashes.tolist(), begin.shares))
    a, b, x, y = (share[h].argmax() for h in hmm._hash([b"a", b"b", b"x", b"y"]).tolist())
    assert a == b != x == y and np.allclose(begin.move.sum(axis=1), 1)


def test_batches_of_texts_are_tokenised_as_single_texts():
    import pyarrow as pa

    texts = [None, "", " ", "a", " a  B ", "É A\x0bb\x0cc\x1cd\x85e\xa0f\x00g", "x1 \t y-2 日本 a1_ " * 40, "\n", "Zz İ K", "w" * 40]
    for some in (texts, [""], [None], ["a b"], texts[::-1]):
        for rows in (pa.array(some, pa.string()), pa.array(some, pa.large_string()), pa.array(["q", *some, "r"]).slice(1, len(some))):
            h, shape, flat, ends = hmm.numbered(rows)
            assert len(set(h.tolist())) == len(h) == len(set(flat.tolist()))
            for i, t in enumerate(some):
                own = flat[ends[i]:ends[i + 1]]
                assert h[own].tolist() == hmm._hash(hmm.tokens_of(t)).tolist()
                assert shape[own].tolist() == [hmm.shape_of(w) for w in hmm.tokens_of(t)]


def test_texts_learned_from_are_scored_in_parts(make_docs, monkeypatch):
    """No scoring pass joins the far words of all learned texts at once, and every text is scored in one of them."""
    monkeypatch.setattr(hmm, "CHUNK", 40)
    texts = [f"a b w{i} a v{i} b" for i in range(150)]
    scored, plain = [], hmm.likelihoods
    monkeypatch.setattr(hmm, "likelihoods", lambda chunks, *more: scored.append(sorted(r["words"] for r in chunks.collect())) or plain(chunks, *more))
    got = sorted((r["_id"], r["score"]) for r in hmm.score_texts(make_docs(texts), words=2, steps=1).collect())
    whole, parts = sum(map(len, scored[1:])), scored[1:]
    assert max(map(len, parts)) < whole and len(got) == len(texts) and len({i for i, _ in got}) == len(texts)
    words = [w for part in scored for chunk in part for w in chunk]
    assert len(words) == len(set(words)) == 2 * len(texts)
    monkeypatch.setattr(hmm, "SCORED_IN", 1)
    again = sorted((r["_id"], r["score"]) for r in hmm.score_texts(make_docs(texts), words=2, steps=1).collect())
    assert [i for i, _ in got] == [i for i, _ in again] and np.allclose([s for _, s in got], [s for _, s in again])
