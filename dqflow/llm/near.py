"""Operator 3: n-gram Jaccard join with Bayesian candidate pruning over MinHash values."""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import saved, ship

ship(__name__)

WORDS = 5
THRESHOLD_NUM, THRESHOLD_DEN = 4, 5
#: 46 bands of 6 values: a pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^46 < 1e-6.
BANDS, ROWS = 46, 6
HASHES = BANDS * ROWS
#: A pair is dropped once the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-7
STEP = 46
BLOCK = 256
#: Buckets with more rows than this verify their pairs inside the task.
SMALL_BUCKET = 16
SLICE = 8192

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 2 ** 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 2 ** 31, HASHES, dtype=np.uint32) * 2 + 1
_PLACE = (_rng.integers(0, 2 ** 63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words; one of all words where there are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    codes = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(cache) < 200_000:
                cache[w] = h
        codes.append(h)
    h = np.array(codes, dtype=np.uint64)
    k = min(WORDS, len(h))
    mixed = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        mixed += h[i:len(h) - k + 1 + i] * _PLACE[i]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def minhash(s: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least value under each of the hash functions."""
    x, least = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2 ** 32 - 1, np.uint32)
    for i in range(0, len(x), SLICE // 8):
        np.minimum(least, ((x[i:i + SLICE // 8, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def _node(s: np.ndarray) -> tuple[int, bytes]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), d


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text_hash, node (one per shingle set, null without words), n, sig of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_text_hash"), F.col(text_col).alias("_t"))

    def sign(batches):
        cache: dict = {}
        for batch in batches:
            nodes, sizes, sigs = [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), cache)
                nodes.append(_node(s)[0] if len(s) else None)
                sizes.append(len(s))
                sigs.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())],
                names=["_id", "_text_hash", "node", "n", "sig"])

    id_type = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(sign, f"_id {id_type}, _text_hash bigint, node bigint, n int, sig binary")


def least_matches(tolerance: float = TOLERANCE) -> list[int]:
    """need[n]: the fewest matches among n values that keep a pair.

    With a uniform prior m matches of n give a Beta(m + 1, n - m + 1) posterior, whose mass at or above t
    is P(Binomial(n + 1, t) <= m).
    """
    t, out = THRESHOLD_NUM / THRESHOLD_DEN, []
    for n in range(HASHES + 1):
        mass, m = 0.0, -1
        while mass < tolerance and m < n:
            m += 1
            mass += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def prune(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) left after comparing their values step by step."""
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    need = least_matches()

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i in range(0, HASHES, STEP):
                j = min(i + STEP, HASHES)
                matches[alive] += (x[alive, i:j] == y[alive, i:j]).sum(axis=1, dtype=np.int32)
                alive = alive[matches[alive] >= need[j]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a bigint, b bigint")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(
        THRESHOLD_DEN * both >= THRESHOLD_NUM * (F.size("x") + F.size("y") - both)).select("a", "b")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node and its shingles for the representatives in ``wanted`` (node, rep)."""
    ids = wanted.select(F.col("rep").alias("_rep")).distinct().hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    texts = texts.join(ids, texts["_id"].eqNullSafe(ids["_rep"]), "left_semi").select("_t")

    def cut(batches):
        cache: dict = {}
        for batch in batches:
            got = [shingles(t.as_py(), cache) for t in batch.column(0)]
            got = [s for s in got if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(s)[0] for s in got], pa.int64()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))],
                names=["node", "shingles"])

    return texts.mapInArrow(cut, "node bigint, shingles array<bigint>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def components(links: DataFrame, name="components") -> DataFrame:
    """node, label: the smallest node of its component, by hooking to the smallest neighbour and pointer jumping."""
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = saved(hooked.join(target, "low").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), name)
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def in_units(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (one per key and node) with the unit of work and the block each belongs to.

    The rows of a key are cut into blocks of about ``BLOCK``; every pair of blocks is a unit, so each pair of rows meets
    in one unit (rows of one block in several) and no unit grows with the key.  Keys of one block share units.
    """
    sized = rows.join(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), key)
    units = max(1, rows.count() // BLOCK)
    return sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "unit", F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64(key), F.lit(units)).cast("string")))
        .otherwise(F.concat_ws(":", F.col(key).cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))))


def links_across(rows: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough of them to join all that belong together.

    ``rows`` has key, node, label.  Pairs are formed and pruned step by step inside the task.  Buckets of up to
    ``SMALL_BUCKET`` rows hand over the pairs left, to be verified afterwards.  Rows of larger ones bring their
    shingles, so pairs are verified at once and only links that join two components come out: fewer
    than rows, however many pairs there are.
    """
    need = least_matches()
    crowded = rows.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > SMALL_BUCKET).select("key")
    few = rows.join(crowded, "key", "left_anti").select("key", "node", "label", F.lit(None).cast("array<bigint>").alias("shingles"))
    many = rows.join(crowded, "key", "left_semi").join(sets, "node").select("key", "node", "label", "shingles")
    dealt = in_units(few.unionByName(many).join(sigs.select("node", "sig"), "node"), "key").select(
        "unit", "key", "node", "label", "sig", "shingles")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, node, label = (t.column(c).to_numpy() for c in ("key", "node", "label"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        lists = t.column("shingles").chunk(0)
        ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
        codes = np.unique(lists.values.to_numpy(), return_inverse=True)[1] if len(lists.values) else np.empty(0, np.int64)
        marked, size = np.zeros(len(codes) + 1, bool), np.diff(ends)
        order, a, b, sure = np.argsort(key, kind="stable"), [], [], []
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            group = label[own].copy()
            for i, r in enumerate(own):
                alive = np.arange(i + 1, len(own))
                alive, matches = alive[group[alive] != group[i]], 0
                for at in range(0, HASHES, STEP):
                    if not len(alive):
                        break
                    matches = matches + (sig[own[alive], at:at + STEP] == sig[r, at:at + STEP]).sum(axis=1, dtype=np.int32)
                    keep = matches >= need[min(at + STEP, HASHES)]
                    alive, matches = alive[keep], matches[keep]
                if not len(alive):
                    continue
                if not valid[r]:
                    links = own[alive]
                else:
                    mine = codes[ends[r]:ends[r + 1]]
                    marked[mine] = True
                    both = np.array([np.count_nonzero(marked[codes[ends[x]:ends[x + 1]]]) for x in own[alive]])
                    marked[mine] = False
                    near = alive[THRESHOLD_DEN * both >= THRESHOLD_NUM * (size[r] + size[own[alive]] - both)]
                    links = []
                    for x in near:
                        if group[x] != group[i]:
                            links.append(own[x])
                            group[group == group[x]] = group[i]
                    links = np.array(links, np.intp)
                a.append(np.minimum(node[links], node[r]))
                b.append(np.maximum(node[links], node[r]))
                sure.append(np.full(len(links), bool(valid[r])))
        empty = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty), "sure": np.concatenate(sure or [np.empty(0, bool)])})

    found = saved(dealt.groupBy("unit").applyInArrow(compare, "a bigint, b bigint, sure boolean").distinct(), "across")
    return found.where("sure").select("a", "b").unionByName(verify(found.where("NOT sure").select("a", "b"), sets))


def count_links(members: DataFrame) -> DataFrame:
    """node, links: copies of other nodes of its class (label) within the threshold; each pair of a class is compared.

    ``members`` has label, node, copies, shingles.  Classes are cut into blocks of about 256 nodes and pairs of blocks
    are the units of work, so no task holds a whole class; blocks of small classes share a unit.
    """
    dealt = in_units(members, "label")

    def compare(t: pa.Table) -> pa.Table:
        node, label, block, copies = (t.column(c).to_numpy() for c in ("node", "label", "block", "copies"))
        sets = t.column("shingles").combine_chunks()
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        links = np.zeros(len(node), np.int64)
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            own = [flat[ends[r]:ends[r + 1]] for r in rows]
            size = np.array([len(s) for s in own])
            _, code, seen = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(rows)), size)
            shared = seen[code] > 1
            code, owner = code[shared], owner[shared]
            by = np.argsort(code, kind="stable")
            code, owner = code[by], owner[by]
            both = np.zeros((len(rows), len(rows)), np.float64)
            rank = np.concatenate([[0], np.cumsum(np.diff(code) > 0)]) if len(code) else code
            for first in range(0, int(rank[-1]) + 1 if len(rank) else 0, SLICE):
                here = slice(*np.searchsorted(rank, [first, first + SLICE]))
                part = np.zeros((len(rows), SLICE), np.float32)
                part[owner[here], rank[here] - first] = 1
                both += part @ part.T
            near = THRESHOLD_DEN * both >= THRESHOLD_NUM * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(near, False)
            mixed = block[rows]
            if len(set(mixed.tolist())) > 1:
                near &= mixed[:, None] != mixed[None, :]
            links[rows] += near @ copies[rows]
        return pa.table({"node": node, "links": links})

    out = dealt.select("unit", "label", "node", "block", "copies", "shingles").groupBy("unit").applyInArrow(compare, "node bigint, links bigint")
    return out.groupBy("node").agg(F.sum("links").alias("links"))


def near_classes(docs: DataFrame, id_col="doc_id", text_col="text", with_links=True, with_label=False) -> DataFrame:
    """One row per input row: _id, _text_hash, class_id (smallest id of the class), n_links; with ``with_label`` also label,
    which tells classes apart where they have no ids (null for texts without words).

    Words are runs of characters other than ASCII white space, shingles are five words; a text of fewer words has
    one shingle, texts without words (null, empty) are classes of their own without links.  Texts with
    one shingle set are one node, so copies meet as one row.  Nodes sharing a band meet the smallest node of the
    bucket; pairs are pruned by posterior, then verified exactly.  Buckets whose nodes are then in
    one component need no further pair; in the others all pairs across components are compared as well, up
    to the links that join them, so classes are the components of all links.  ``n_links`` counts the other rows at a similarity of 0.8 or more,
    copies included.  Null ids are ignored in class_id; repeated rows count as copies.  Empty tables give no rows.
    """
    signed = saved(signatures(docs, id_col, text_col), "signatures")
    nodes = saved(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "nodes")
    buckets = nodes.select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))).alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    mates = saved(buckets.join(leaders.select("key", "leader"), "key"), "mates")
    sets = saved(shingle_sets(docs, id_col, text_col, nodes.select("node", "rep").join(
        mates.select("node").distinct(), "node", "left_semi")), "sets")
    stars = mates.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(verify(prune(stars, nodes), sets), "links")
    labels = components(links)

    named = mates.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    more = saved(links_across(named.join(mixed, "key"), nodes, sets), "links")
    if not more.isEmpty():
        labels = components(links.union(more), "components2")

    grouped = nodes.join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    classes = grouped.groupBy("label").agg(F.min("rep").alias("class_id"))
    info = grouped.join(classes, "label").select("node", "class_id", "copies", *(["label"] if with_label else []))
    if with_links:
        links_of = count_links(labels.join(sets, "node").join(nodes.select("node", "copies"), "node"))
        info = info.join(links_of, "node", "left")
    else:
        info = info.withColumn("links", F.lit(None).cast("bigint"))
    info = info.withColumnRenamed("node", "_node")
    return signed.join(info, signed["node"] == info["_node"], "left").select(
        "_id", "_text_hash", F.coalesce("class_id", "_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), *(["label"] if with_label else []))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id stays, null ids come last, and of rows sharing that id the one
    with the smallest hash of its text; rows repeated with id and text count once.  Texts without words are no copies
    of each other, but count once for each id."""
    classes = near_classes(docs, id_col, text_col, with_links=False, with_label=True)
    first = classes.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_text_hash")).alias("s"))
    stay = first.select("s._id", "s._text_hash").unionByName(classes.where("label IS NULL").select("_id", "_text_hash").distinct())
    stay = saved(stay, "stay").hint("shuffle_hash")
    hashed = docs.withColumn("_h", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = hashed.join(stay, hashed[id_col].eqNullSafe(stay["_id"]) & (hashed["_h"] == stay["_text_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "_h"]).drop("_h")
