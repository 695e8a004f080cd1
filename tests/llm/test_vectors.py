"""Clustering, product codes and exact duplicates against plain versions on hand-made rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from dqflow.llm import bitplanes, covertree
from dqflow.llm.bitplanes import cluster_vectors, pack, products
from dqflow.llm.covertree import compress_vectors
from dqflow.llm.exact import exact_duplicates

ROWS = "vec_id bigint, embedding array<double>, label int, cluster string, _ID int, Code double"


def odd_rows(d, n=60, seed=2):
    """Random vectors, copies, ties, and rows that do not count."""
    rng = np.random.default_rng(seed)
    base = [rng.normal(0, 0.4, d).tolist() for _ in range(n)]
    base += [base[3]] * 40 + [[0.5] * d, [-0.5] * d, [1e-9] * d, [-1e-9] * d, [700.25] * d]
    bad = [None, [], [None] * d, [0.1] * (d - 1) + [float("nan")], [0.1] * (d - 1) + [float("inf")], [-math.inf] * d]
    ids = [*range(100, 100 + len(base)), *range(len(bad))]
    return [(i, v, None if i % 4 == 0 else i % 3, "x", 1, 2.0) for i, v in zip(ids, base + bad)]


def good(rows, length=None):
    return [r for r in rows if r[1] is not None and (length is None or len(r[1]) == length) and all(x is not None and math.isfinite(x) for x in r[1])]


def floors(v):
    return [math.floor(1024 * x) for x in v]


def lloyd(points, centres, rounds):
    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(centres)) for p in points]
    for _ in range(rounds):
        own = near()
        for i in range(len(centres)):
            mine = [p for p, (_, j) in zip(points, own) if j == i]
            if mine:
                centres = [*centres[:i], [sum(x) // len(mine) for x in zip(*mine)], *centres[i + 1:]]
    return centres, near()


def test_products_of_packed_vectors():
    rng = np.random.default_rng(5)
    for d, bits in ((64, 11), (64, 28), (7, 3), (130, 9)):
        a, b = (rng.integers(-(1 << bits - 1), 1 << bits - 1, (n, d)) for n in (50, 9))
        assert (products(pack(a, bits), pack(b, bits), bits) == a @ b.T).all()
        assert (bitplanes.component_sums(pack(a, bits), bits, d) == a.sum(axis=0)).all()


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (500, 2)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    rows = odd_rows(64)
    rows.append((999, [0.1] * 63, 1, "x", 1, 2.0))
    kept = sorted(good(rows, 64), key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    points = [floors(r[1]) for r in kept]
    centres, own = lloyd(points, points[:k], rounds)
    got = {r["_id"]: r for r in cluster_vectors(spark.createDataFrame(rows, ROWS).repartition(3), k=k, rounds=rounds).collect()}
    assert sorted(got) == sorted(r[0] for r in kept)
    for r, (distance, c) in zip(kept, own):
        x = got[r[0]]
        assert (x["cluster"], x["distance"]) == (c, distance)
        assert x["cluster_inertia"] == sum(d for d, j in own if j == c) and x["inertia"] == sum(d for d, _ in own)
        assert x["centroid_sha256"] == brute.sha(",".join(map(str, centres[c])))


def test_clusters_of_nothing_null_ids_and_large_components(spark):
    rows = odd_rows(64)
    df = spark.createDataFrame(rows, ROWS)
    assert cluster_vectors(df.where("false")).count() == 0
    assert cluster_vectors(df.where("vec_id < 100")).columns == cluster_vectors(df).columns
    nameless = cluster_vectors(df.withColumn("vec_id", F.lit(None).cast("bigint"))).collect()
    assert len(nameless) == len(good(rows, 64)) and {r["_id"] for r in nameless} == {None}
    twice = cluster_vectors(df.union(df)).collect()
    assert len(twice) == 2 * len(nameless)
    with pytest.raises(ValueError):
        cluster_vectors(df.withColumn("embedding", F.array_repeat(F.lit(1e9), 64)))


def test_tree_covers_and_separates():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-500, 500, (900, 4)), rng.integers(-3, 3, (900, 4)), np.zeros((300, 4), np.int64)])
    tree = covertree.grow(points)
    assert (points[tree.places] == tree.points).all() and sorted(tree.places) == list(range(len(points)))
    for n in tree.nodes:
        inside = tree.points[n["start"]:n["end"]]
        assert ((inside - inside[0]) ** 2).sum(axis=1).max() <= n["radius"] ** 2 * (1 + 1e-12)
        if n["children"]:
            kids = tree.nodes[n["child"]:n["child"] + n["children"]]
            assert kids["start"][0] == n["start"] and kids["end"][-1] == n["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
            centres = tree.points[kids["start"]]
            gaps = covertree.squared(centres, centres)[np.triu_indices(len(kids), 1)]
            assert len(kids) == 1 or gaps.min() > kids["radius"].max() ** 2


def test_subtrees_get_what_single_points_get():
    rng = np.random.default_rng(4)
    for spread, k in ((2, 5), (40, 256), (3000, 30)):
        middles = rng.integers(-spread * 40, spread * 40, (12, 16))
        points = middles[rng.integers(0, 12, 1500)] + rng.integers(-spread, spread + 1, (1500, 16))
        book = np.concatenate([points[:k - 1], points[:1]])
        tree = covertree.grow(points)
        want = covertree.squared(points, book).argmin(axis=1)
        code, error = covertree.codes(tree, book)
        assert (code == want).all() and (error == ((points - book[want]) ** 2).sum(axis=1)).all()
        n, s = covertree.totals(tree, book)
        assert (n == np.bincount(want, minlength=k)).all()
        assert all((s[i] == points[want == i].sum(axis=0)).all() for i in range(k))
    whole = covertree.settle(tree, book)[0]
    assert tree.nodes["end"][whole].sum() - tree.nodes["start"][whole].sum() > 0 and (tree.nodes["end"] - tree.nodes["start"])[whole].max() > 20
    wide = rng.integers(-(1 << 26), 1 << 26, (200, 16))
    assert (covertree.codes(covertree.grow(wide), wide[:20])[0] == np.argmin([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in wide[:20]] for x in wide], axis=1)).all()


@pytest.mark.parametrize("d,entries,block", [(8, 256, 2048), (8, 5, 16), (64, 7, 2048)])
def test_codes_against_plain_rounds(spark, monkeypatch, d, entries, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = [r for r in odd_rows(d) if r[1] != []]
    kept = sorted(good(rows))
    width, codes, error, books = d // 4, ["" for _ in kept], [0 for _ in kept], []
    for p in range(4):
        points = [floors(r[1])[p * width:(p + 1) * width] for r in kept]
        book, own = lloyd(points, points[:entries], 4)
        books += [str(x) for c in book for x in c]
        codes = [a + f"{j:02x}" for a, (_, j) in zip(codes, own)]
        error = [a + e for a, (e, _) in zip(error, own)]
    got = {r["_id"]: r for r in compress_vectors(spark.createDataFrame(rows, ROWS).repartition(3), entries=entries).collect()}
    assert sorted(got) == [r[0] for r in kept]
    for r, code, e in zip(kept, codes, error):
        x = got[r[0]]
        assert (x["code"], x["error"], x["_label"]) == (code, e, r[2])
        assert x["label_error"] == sum(e2 for r2, e2 in zip(kept, error) if r2[2] == r[2])
        assert x["codebooks_sha256"] == brute.sha(",".join(books))


def test_codes_of_nothing_short_vectors_and_null_ids(spark):
    df = spark.createDataFrame(odd_rows(8), ROWS)
    assert compress_vectors(df.where("false")).count() == 0
    assert compress_vectors(df.where("false")).columns == compress_vectors(df).columns
    ragged = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0, 0.0, 0.0, 0.0], 0), (None, [], None), (None, [3.0], None)],
                                   "vec_id bigint, embedding array<float>, label int")
    rows = compress_vectors(ragged).collect()
    assert len(rows) == 4 and len({r["code"] for r in rows if r["_id"]}) == 1 and all(r["error"] == 0 for r in rows)
    assert compress_vectors(df.union(df)).count() == 2 * compress_vectors(df).count()
    with pytest.raises(ValueError):
        compress_vectors(df.withColumn("embedding", F.array(F.lit(1e15))))


TEXTS = [*["Same Text"] * 40, "same text", "SAME TEXT", "same  text", None, "", "É", "é", "x" * 300_000, "X" * 300_000, "one", "ONE"]


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.ascii_lower(t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = max(named, default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            stays = i == keep and first
            first = first and not stays
            out.append((i, keep, len(ids), stays, brute.sha(t)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [None, lambda t: F.length(t) % 3, lambda t: F.lit(1)])
@pytest.mark.parametrize("ids", ["own", "repeated", "null"])
def test_exact_copies(spark, digest, ids):
    named = {"own": range(len(TEXTS)), "repeated": [i // 3 for i in range(len(TEXTS))], "null": [None if i % 3 else i for i in range(len(TEXTS))]}[ids]
    rows = list(zip(named, TEXTS))
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id bigint, text string, _Digest int, KEPT string").repartition(3)
    got = exact_duplicates(df, digest=digest)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_copies(rows)


def test_exact_copies_of_no_rows_and_no_ids(spark, make_docs):
    assert exact_duplicates(make_docs([])).count() == 0
    rows = exact_duplicates(make_docs(["a", "A", "b"]).withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    assert sorted((r["group_size"], r["kept"], r["keep_id"]) for r in rows) == [(1, True, None), (2, False, None), (2, True, None)]
