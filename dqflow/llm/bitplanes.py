"""Operator 11: centroid clustering by weighted popcounts over bit planes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import saved, ship

ship(__name__)

WORD = 64
#: Beyond this size of a component, squared distances of 64 components leave the range of a long.
LARGEST = 1 << 27
#: Vectors whose products with the centroids are held at once.
AT_ONCE = 4096


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has exactly ``dimensions`` components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def plane_weights(planes: int) -> np.ndarray:
    """2^p for plane p of two's complement; the last one carries the sign."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, d) integers to (n, planes, words): bit b of word w of plane p is bit p of component 64 w + b."""
    n, d = values.shape
    padded = np.zeros((n, -(-d // WORD) * WORD), np.int64)
    padded[:, :d] = values
    bits = ((padded[:, None, :] >> np.arange(planes)[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def products(a: np.ndarray, b: np.ndarray, planes: int) -> np.ndarray:
    """Exact dot products of packed vectors (n, planes, words) and (k, planes, words): (n, k)."""
    w, k = plane_weights(planes), len(b)
    out = np.zeros((len(a), k), np.int64)
    flat = b.reshape(k * planes, -1)
    for p in range(planes):
        ones = sum(np.bitwise_count(a[:, p, i, None] & flat[None, :, i]).astype(np.int64) for i in range(a.shape[2]))
        out += w[p] * (ones.reshape(len(a), k, planes) @ w)
    return out


def nearest(a: np.ndarray, norms: np.ndarray, b: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance to it."""
    own = np.array([products(b[i:i + 1], b[i:i + 1], planes)[0, 0] for i in range(len(b))], np.int64)
    best, distance = np.empty(len(a), np.int32), np.empty(len(a), np.int64)
    for i in range(0, len(a), AT_ONCE):
        d = norms[i:i + AT_ONCE, None] - 2 * products(a[i:i + AT_ONCE], b, planes) + own[None, :]
        best[i:i + AT_ONCE] = d.argmin(axis=1)
        distance[i:i + AT_ONCE] = d.min(axis=1)
    return best, distance


def component_sums(a: np.ndarray, planes: int, d: int) -> np.ndarray:
    """Sums of the components of packed vectors, from the number of ones at each bit of each plane."""
    out = np.zeros(d, np.int64)
    for i in range(0, len(a), AT_ONCE):
        part = np.ascontiguousarray(a[i:i + AT_ONCE])
        ones = np.unpackbits(part.view(np.uint8).reshape(len(part), planes, -1), axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
        out += plane_weights(planes) @ ones[:, :d]
    return out


def planes_of(column, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), planes, -1)


def packed_vectors(vectors: DataFrame, planes: int, scale: int) -> DataFrame:
    """_id, planes (binary: the words of every plane), norm (squared length) of the rows of ``vectors`` (_id, _v)."""
    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            values = np.floor(flat.reshape(batch.num_rows, -1) * scale).astype(np.int64)
            words = pack(values, planes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in words], pa.binary()), pa.array((values * values).sum(axis=1))],
                names=["_id", "planes", "norm"])

    return vectors.mapInArrow(work, f"_id {dict(vectors.dtypes)['_id']}, planes binary, norm bigint")


def moved(packed: DataFrame, centroids: np.ndarray, planes: int) -> np.ndarray:
    """One round: the centroids after every vector has been assigned; centroids without vectors stay.

    Each task sends one row per centroid that it met: a count and the sums of the components.
    """
    k, d = centroids.shape
    codes = pack(centroids, planes)

    def work(batches: Iterator[pa.RecordBatch]):
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            a = planes_of(batch.column(0), planes)
            best, _ = nearest(a, batch.column(1).to_numpy(), codes, planes)
            count += np.bincount(best, minlength=k)
            for c in np.unique(best):
                total[c] += component_sums(a[best == c], planes, d)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    partial = packed.select("planes", "norm").mapInArrow(work, "c int, n bigint, s array<bigint>")
    # At most k rows of d numbers come back.
    sums = partial.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)]).collect()
    out = centroids.copy()
    for r in sums:
        out[r["c"]] = [r[2 + i] // r["n"] for i in range(d)]
    return out


def assigned(packed: DataFrame, centroids: np.ndarray, planes: int) -> DataFrame:
    """_id, cluster, distance."""
    codes = pack(centroids, planes)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(planes_of(batch.column(1), planes), batch.column(2).to_numpy(), codes, planes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(distance)], names=["_id", "cluster", "distance"])

    return packed.mapInArrow(work, f"_id {dict(packed.dtypes)['_id']}, cluster int, distance bigint")


def cluster_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", dimensions=64, k=8, rounds=10, scale=1024,
                    seed="3:") -> DataFrame:
    """Per usable vector: _id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors with exactly ``dimensions`` components, none null or non-finite, count; components become floor(scale * x).
    The vectors are packed once into bit planes (as many as the largest component needs) and stored; each round reads
    only those, and all that a round sends is one row per task and centroid.  Distances are exact.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed`` and id.  Null ids come last there,
    equal ids are ordered by their packed planes; repeated rows count as often as they occur.  With fewer than ``k``
    usable vectors there are fewer centroids, with none there are no rows.  Components beyond 2^27 raise an error
    (their squared distances are no longs).  Other columns are ignored.
    """
    vector = F.col(vector_col).cast("array<double>")
    vectors = rows.select(F.col(id_col).alias("_id"), vector.alias("_v")).where(usable(vector, dimensions))
    reach = vectors.agg(F.max(F.array_max("_v")).alias("most"), F.min(F.array_min("_v")).alias("least")).first()
    result = f"_id {dict(vectors.dtypes)['_id']}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if reach["most"] is None:
        return rows.sparkSession.createDataFrame([], result)
    most, least = (int(np.floor(x * scale)) for x in reach)
    if max(abs(most), abs(least)) > LARGEST:
        raise ValueError(f"components of {least} to {most} after scaling: squared distances leave the range of a long")
    planes = 1 + max(most, -1 - least, 1).bit_length()
    packed = saved(packed_vectors(vectors, planes, scale), "planes")
    order = F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256)
    first = packed.orderBy(order.asc_nulls_last(), "planes").limit(k).select("planes").collect()
    bits = np.unpackbits(np.frombuffer(b"".join(r[0] for r in first), np.uint8).reshape(len(first), planes, -1), axis=2, bitorder="little")
    centroids = np.einsum("p,kpd->kd", plane_weights(planes), bits.astype(np.int64))[:, :dimensions]
    for _ in range(rounds):
        after = moved(packed, centroids, planes)
        if (after == centroids).all():
            break
        centroids = after
    final = saved(assigned(packed, centroids, planes), "clusters")
    sums = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertia = F.lit(sum(sums.values())).cast("bigint")
    own = F.create_map(*[x for c, s in sums.items() for x in (F.lit(c), F.lit(s).cast("bigint"))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    return final.select("_id", "cluster", "distance", own[F.col("cluster")].alias("cluster_inertia"), inertia.alias("inertia"),
                        digests[F.col("cluster")].alias("centroid_sha256"))
