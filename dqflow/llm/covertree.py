"""Operator 13: product codes of vectors; Lloyd rounds that assign whole subtrees of cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import saved, ship
from dqflow.operators.skew import attach_stats

ship(__name__)

#: Vectors of one tree, and the largest node that is not divided further.
BLOCK, LEAF = 2048, 24
#: Centres that one step of a division compares with the points still to be covered.
CENTRES = 128
EXACT_DOUBLE = 1 << 52
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])
TREES = "array<struct<points:binary,places:binary,nodes:binary>>"
ARROW_TREES = pa.list_(pa.struct([("points", pa.binary()), ("places", pa.binary()), ("nodes", pa.binary())]))


class Tree(NamedTuple):
    """Points in depth-first order, their places in the block, and the nodes as ranges of points.

    A node's first point is its centre.  Children cover their points within a power of two below the node's radius,
    and their centres lie further apart than that; the first child has the node's own centre.
    """

    points: np.ndarray
    places: np.ndarray
    nodes: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows: in doubles where all sums stay below 2^52, else in 64-bit integers."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.float64 if 4 * a.shape[1] * most * most < EXACT_DOUBLE else np.int64
    a, b = a.astype(kind), b.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def grow(points: np.ndarray) -> Tree:
    """The cover tree of integer points (n, w), n > 0."""
    order, nodes, at = np.arange(len(points), dtype=np.int32), [[0, len(points), 0, 0, 0.0]], 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        own = order[start:end]
        far = float(squared(points[own[:1]], points[own]).max())
        nodes[at][4] = far ** 0.5
        if end - start > LEAF and far:
            scale = 4.0 ** np.floor(np.log2(far) / 2)
            parts = divided(points, own, scale / 4 if scale >= far else scale)
            order[start:end] = np.concatenate(parts)
            nodes[at][2:4] = len(nodes), len(parts)
            for part in parts:
                nodes.append([start, start + len(part), 0, 0, 0.0])
                start += len(part)
        at += 1
    return Tree(points[order], order, np.array([tuple(x) for x in nodes], NODE))


def divided(points: np.ndarray, own: np.ndarray, reach: float) -> list[np.ndarray]:
    """``own`` as groups within a squared distance of ``reach`` from their first point, those points being further apart."""
    parts, rest = [], own
    while len(rest):
        near = squared(points[rest[:CENTRES]], points[rest]) <= reach
        free = np.ones(len(rest), bool)
        for i in range(len(near)):
            if free[i]:
                mine = near[i] & free
                free &= ~mine
                mine[i] = False
                parts.append(np.concatenate([rest[i:i + 1], rest[mine]]))
        rest = rest[free]
    return parts


def members(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the given ranges."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def settle(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes whose points all have one nearest entry, that entry; single points (positions) and theirs.

    An entry further from the centre than the nearest one by more than twice the radius is nearest to no point of the
    node.  Where one entry is left the subtree is done; other nodes hand the entries left to their children, and
    leaves compare their points with them one by one.  Ties go to the smaller index, as all comparisons of points
    (and of nodes that hold copies of one point) are exact.
    """
    nodes = tree.nodes
    at, left = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    whole, entry, single, own = [], [], [], []
    while len(at):
        here = nodes[at]
        d = np.where(left, squared(tree.points[here["start"]], book), np.inf)
        best, away = d.argmin(axis=1), np.sqrt(d)
        near, radius = away.min(axis=1), here["radius"]
        left &= away <= (near + 2 * radius + 1e-9 * (1 + near + radius))[:, None]
        done = (left.sum(axis=1) == 1) | (radius == 0)
        whole.append(at[done])
        entry.append(best[done])
        leaf = ~done & (here["children"] == 0)
        if leaf.any():
            spots = members(here["start"][leaf], here["end"][leaf])
            of = np.repeat(np.flatnonzero(leaf), (here["end"] - here["start"])[leaf])
            own.append(np.where(left[of], squared(tree.points[spots], book), np.inf).argmin(axis=1))
            single.append(spots)
        inner = ~done & ~leaf
        at = members(here["child"][inner], here["child"][inner] + here["children"][inner])
        left = np.repeat(left[inner], here["children"][inner], axis=0)
    none = np.empty(0, np.int64)
    return np.concatenate(whole), np.concatenate(entry), np.concatenate([none, *single]), np.concatenate([none, *own])


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of every entry; subtrees by differences of cumulative sums."""
    whole, entry, single, own = settle(tree, book)
    n, s = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    upto = np.concatenate([np.zeros((1, book.shape[1]), np.int64), np.cumsum(tree.points, axis=0, dtype=np.int64)])
    here = tree.nodes[whole]
    np.add.at(n, entry, here["end"] - here["start"])
    np.add.at(s, entry, upto[here["end"]] - upto[here["start"]])
    np.add.at(n, own, 1)
    np.add.at(s, own, tree.points[single])
    return n, s


def codes(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exact squared distance of every point, in the order of the block."""
    whole, entry, single, own = settle(tree, book)
    here = tree.nodes[whole]
    code = np.empty(len(tree.points), np.int64)
    code[members(here["start"], here["end"])] = np.repeat(entry, here["end"] - here["start"])
    code[single] = own
    out, error = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
    out[tree.places] = code
    error[tree.places] = ((tree.points - book[code]) ** 2).sum(axis=1)
    return out, error


def read_tree(stored: dict, width: int) -> Tree:
    return Tree(np.frombuffer(stored["points"], "<i4").reshape(-1, width).astype(np.int64),
                np.frombuffer(stored["places"], "<i4"), np.frombuffer(stored["nodes"], NODE))


def as_integers(column, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the rows of a list column, shorter rows filled with zeros up to ``width``."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def planted(vectors: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """ids, labels, trees (one per part) of blocks of at most ``BLOCK`` rows of ``vectors`` (_id, _label, _v)."""
    def block(ids, labels, values):
        trees = [grow(x) for x in np.split(values, parts, axis=1)]
        stored = [{"points": t.points.astype("<i4").tobytes(), "places": t.places.tobytes(), "nodes": t.nodes.tobytes()} for t in trees]
        whole = pa.array([0, len(values)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, labels), pa.array([stored], ARROW_TREES)], names=["ids", "labels", "trees"])

    def work(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(i, BLOCK)
                held.append((piece.column(0), piece.column(1), as_integers(piece.column(2), width, scale)))
                size += piece.num_rows
                if size >= BLOCK:
                    ids, labels, values = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
                    yield block(ids[:BLOCK], labels[:BLOCK], values[:BLOCK])
                    size -= BLOCK
                    held = [(ids[BLOCK:], labels[BLOCK:], values[BLOCK:])] if size else []
        if size:
            yield block(*[pa.concat_arrays([h[i] for h in held]) for i in (0, 1)], np.concatenate([h[2] for h in held]))

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(work, f"ids array<{kinds['_id']}>, labels array<{kinds['_label']}>, trees {TREES}")


def improved(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: the codebooks (parts, entries, width) after every part has been assigned; unused entries stay."""
    parts, k, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]):
        n, s = np.zeros((parts, k), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.column(0):
                for p, stored in enumerate(row.as_py()):
                    dn, ds = totals(read_tree(stored, width), books[p])
                    n[p] += dn
                    s[p] += ds
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(s[part, entry]), pa.list_(pa.int64()))],
            names=["p", "c", "n", "s"])

    partial = forest.select("trees").mapInArrow(work, "p int, c int, n bigint, s array<bigint>")
    # One row per part and entry comes back.
    sums = partial.groupBy("p", "c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]).collect()
    out = books.copy()
    for r in sums:
        out[r["p"], r["c"]] = [r[3 + i] // r["n"] for i in range(width)]
    return out


def coded(forest: DataFrame, books: np.ndarray) -> DataFrame:
    """_id, _label, code (two hex digits per part), error of every vector."""
    width = books.shape[2]

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                found = [codes(read_tree(stored, width), books[p]) for p, stored in enumerate(batch.column(2)[i].as_py())]
                text = [c.tobytes().hex() for c in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(text), pa.array(sum(f[1] for f in found))],
                    names=["_id", "_label", "code", "error"])

    kinds = dict(forest.dtypes)
    return forest.mapInArrow(work, f"_id {kinds['ids'][6:-1]}, _label {kinds['labels'][6:-1]}, code string, error bigint")


def compress_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", parts=4, entries=256, rounds=4,
                     scale=1024) -> DataFrame:
    """Per usable vector: _id, _label, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are left out; components become floor(scale * x).
    Every block of 2,048 vectors of a task gets a cover tree per part, built once and stored; a round reads the trees
    and sends one row per task, part and entry.  A round compares the codebook with nodes and settles whole subtrees by
    the triangle inequality; only ambiguous leaves compare their points, exactly.

    The codebooks start as the parts of the ``entries`` (at most 256) smallest ids; null ids come last there, equal ids
    are ordered by their vectors, repeated rows count as often as they occur.  Fewer vectors than entries give
    shorter codebooks, none give no rows.  Vectors shorter than the longest one, or of a length that ``parts`` does not
    divide, are filled with zeros at their end.  Components so large that squared distances leave the range of a
    long raise an error.  Other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    fit = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), vector.alias("_v")).where(F.col("_v").isNotNull() & fit)
    reach = vectors.agg(F.max(F.array_max(F.transform("_v", F.abs))).alias("most"), F.max(F.size("_v")).alias("size")).first()
    kinds = dict(vectors.dtypes)
    if reach["size"] is None:
        return rows.sparkSession.createDataFrame(
            [], f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = max(1, -(-reach["size"] // parts))
    most = int((reach["most"] or 0.0) * scale) + 1
    if 4 * width * parts * most * most >= 1 << 63 or most >= 1 << 31:
        raise ValueError(f"components of {most} after scaling: squared distances leave the range of a long")
    forest = saved(planted(vectors, width * parts, parts, scale), "trees")
    first = vectors.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    books = as_integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width * parts, scale)
    books = np.stack(np.split(books, parts, axis=1))
    for _ in range(rounds):
        books = improved(forest, books)
    found = saved(coded(forest, books), "codes")
    # Equal labels meet by value and by being null, as joins never match nulls.
    keyed = found.withColumns({"_no_label": F.col("_label").isNull(), "_same": F.coalesce(F.col("_label").cast("string"), F.lit(""))})
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return attach_stats(keyed, ["_no_label", "_same"], [F.sum("error").alias("label_error")]).select(
        "_id", "_label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
