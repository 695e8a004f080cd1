"""Operator 1: repeated 200-byte strings by two-stage suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import saved, ship, text_of

ship(__name__)

#: Grams whose least hash names a window: every window of ``span`` bytes holds span - GRAM + 1 of them.
GRAM = 64
CHUNK = 1 << 18
LONGEST_RUN = 4096
#: Marks a number of windows; places pack a first start and a marked number in one long.
TWICE, PLACE = 8192, 16384
SORT_AT_ONCE = 2_000_000
#: Keys with more distinct blocks than this are compared window by window instead of in one task.
HOT_BLOCKS = 50_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _slide(least, a: np.ndarray, width: int) -> np.ndarray:
    """``least`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        a = least(a[:-size], a[size:])
        size *= 2
    return least(a[: len(a) - (width - size)], a[width - size:]) if size < width else a


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        size *= 2
    return _mix(h)


def runs(text: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one key: key, first start, number of windows (``LONGEST_RUN`` at most).

    A window's key is the least hash of its 64-byte grams, so equal windows have equal keys.  Where a run holds its
    least gram twice, a window may repeat inside the run: ``TWICE`` is added to the number.
    """
    keys, firsts, sizes, width = [], [], [], span - GRAM + 1
    for at in range(0, max(0, len(text) - span + 1), CHUNK):
        g = gram_hashes(np.frombuffer(text, np.uint8, min(CHUNK + span - 1, len(text) - at), at))
        k = _slide(np.minimum, g, width)
        edge = np.zeros(width - 1, np.uint64)
        # A gram is the least of some window where its hash is the largest key of the windows around it.
        least = np.flatnonzero(g == _slide(np.maximum, np.concatenate([edge, k, edge]), width))
        again = (g[least[1:]] == g[least[:-1]]) & (np.diff(least) <= width)
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        cut = np.union1d(np.concatenate([[0], edges]), np.arange(0, len(k), LONGEST_RUN)).astype(np.int64)
        size = np.diff(np.append(cut, len(k)))
        if again.any():
            size[np.isin(k[cut], g[least[1:]][again])] += TWICE
        keys.append(k[cut])
        firsts.append(cut + at)
        sizes.append(size)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(firsts), np.concatenate(sizes)


def two_stage_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted suffixes of ``t`` in order of their first ``depth`` bytes at least (``t`` ends with padding of that length).

    Suffixes smaller than their successors are sorted directly.  The others follow by scanning the buckets of
    first bytes upwards: whatever is placed places its predecessor, if that is larger, at the head part of the
    predecessor's bucket.  Successors that only the scan needs are added, up to the next smaller one.
    """
    n = len(t) - depth + 1
    differs = np.flatnonzero(t[:-1] != t[1:])
    following = np.searchsorted(differs, np.arange(n))
    has = following < len(differs)
    at = differs[np.minimum(following, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n, np.int64)
    small = ~has | (t[at] < t[np.minimum(at + 1, len(t) - 1)]) if len(differs) else np.ones(n, bool)
    small[n - 1] = True
    need = np.zeros(n, bool)
    need[wanted] = True
    # A larger suffix needs all its successors up to the first smaller one.
    ends = np.flatnonzero(small)
    reach = np.zeros(n + 1, np.int32)
    large = wanted[~small[wanted]]
    np.add.at(reach, large, 1)
    np.add.at(reach, ends[np.searchsorted(ends, large)] + 1, -1)
    need |= np.cumsum(reach[:n]) > 0
    direct = np.flatnonzero(need & small)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(t, depth)[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    induced_from = need & ~small
    starts = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def place(done: np.ndarray, c: int) -> np.ndarray:
        before = done[done > 0] - 1
        before = before[induced_from[before]]
        first = t[before]
        same = before[first == c]
        before, first = before[first != c], first[first != c]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cut = np.flatnonzero(np.diff(first)) + 1
        if len(first):
            for c2, part in zip(first[np.concatenate([[0], cut])], np.split(before, cut)):
                pending[c2].append(part)
        return same

    for c in range(256):
        here = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(here):
            out.append(here)
            here = place(here, c)
        tail = direct[starts[c]:starts[c + 1]]
        if len(tail):
            out.append(tail)
            place(tail, c)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]]


def common_prefix_reaches(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes a[i] and b[i] share ``depth`` bytes, eight at a time over the pairs still equal."""
    words = np.lib.stride_tricks.sliding_window_view(t, 8)
    alive = np.arange(len(a))
    for i in [*range(0, depth - 8, 8), depth - 8]:
        x = np.ascontiguousarray(words[a[alive] + i]).view(np.uint64).ravel()
        y = np.ascontiguousarray(words[b[alive] + i]).view(np.uint64).ravel()
        alive = alive[x == y]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def covered(blocks: list[bytes], counts: list[int], span: int) -> list[list[dict]]:
    """Per block the merged byte ranges of its windows that occur elsewhere too (a block's count tells its own copies)."""
    sizes = np.array([len(b) for b in blocks])
    t = np.concatenate([np.frombuffer(b"".join(blocks), np.uint8), np.zeros(span, np.uint8)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    windows = np.repeat(begin[:-1], sizes - span + 1) + np.concatenate([np.arange(s - span + 1) for s in sizes])
    order = two_stage_order(t, windows, span)
    same = common_prefix_reaches(t, order[:-1], order[1:], span)
    hit = np.zeros(len(t), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [ranges(np.flatnonzero(hit[a:b - span + 1]) if c < 2 else np.arange(b - a - span + 1), span)
            for a, b, c in zip(begin, begin[1:], counts)]


def ranges(starts: np.ndarray, span: int) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [{"a": int(p[0]), "b": int(p[-1]) + span} for p in np.split(starts, cut)]


PIECES = "array<struct<a:bigint,b:bigint>>"
ARROW_PIECES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def scan(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """_id, key (hash of the text), n_bytes, sha, and the runs of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_t")).select(
        "_id", F.xxhash64("_t").alias("key"), F.length("_t").cast("bigint").alias("n_bytes"), F.sha2("_t", 256).alias("sha"), "_t")

    def cut(batches):
        for batch in batches:
            got = [runs(x.as_buffer().to_pybytes(), span) for x in batch.column(4)]
            ends = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g[i] for g in got]) if got else np.empty(0, np.int64)))
                     for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["_id", "key", "n_bytes", "sha", "h", "first", "size"])

    id_type = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(cut, f"_id {id_type}, key bigint, n_bytes bigint, sha string, h array<bigint>, first array<bigint>, size array<bigint>")


def sort_blocks(blocks: DataFrame, span: int) -> DataFrame:
    """h, block, pieces: blocks of one key meet in one task, which sorts the suffixes of about 2 MB of keys at a time."""
    def work(batches):
        held: list = []
        size = 0

        def flush():
            found = covered([x[2] for x in held], [x[3] for x in held], span)
            rows = [(x[0], x[1], f) for x, f in zip(held, found) if f]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], ARROW_PIECES)],
                names=["h", "block", "pieces"])

        for batch in batches:
            for h, block, data, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if size >= SORT_AT_ONCE and held[-1][0] != h:
                    yield flush()
                    held, size = [], 0
                held.append((h, block, data, n))
                size += len(data)
        if held:
            yield flush()

    return blocks.select("h", "block", "data", "n").repartition("h").sortWithinPartitions("h").mapInArrow(
        work, f"h bigint, block bigint, pieces {PIECES}")


def match_windows(blocks: DataFrame, span: int) -> DataFrame:
    """h, block, pieces of hot keys: one row per window, grouped by 128 bits of hash, so that no task holds a key."""
    def cut(batches):
        for batch in batches:
            for h, block, data, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                size = len(data) - span + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, h)), pa.array(np.full(size, block)), pa.array(np.arange(size)), pa.array(np.full(size, n)),
                    pa.array([xxhash.xxh3_128_digest(data[i:i + span]) for i in range(size)], pa.binary())], names=["h", "block", "at", "n", "w"])

    windows = blocks.select("h", "block", "data", "n").mapInArrow(cut, "h bigint, block bigint, at bigint, n bigint, w binary")
    twice = windows.groupBy("w").agg(F.sum("n").alias("all")).where("all > 1").select("w")
    hits = windows.join(twice, "w", "left_semi").groupBy("h", "block").agg(F.collect_list("at").alias("ats"))
    return hits.select("h", "block", F.transform("ats", lambda a: F.struct(a.alias("a"), (a + span).alias("b"))).alias("pieces"))


def drop_repeats(docs: DataFrame, id_col="doc_id", text_col="text", span=200, hot_blocks=HOT_BLOCKS) -> DataFrame:
    """Per row: _id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte ranges), kept (text without them; null if unchanged).

    A byte goes if a ``span``-byte string over it also starts anywhere else, in the same text or another; strings are
    judged on the input.  Windows are keyed by their least gram hash, so equal windows have one key; keys met once
    cannot repeat.  For the others the text of each run of windows travels as a block (equal blocks once, with
    their number), and the blocks of a key are suffix-sorted in one task.  A key of more than ``hot_blocks``
    distinct blocks is compared window by window instead, over all tasks.

    Null texts are empty; texts shorter than ``span`` keep all bytes; repeated rows are repeats of each other; texts
    are told apart by 64 bits of hash and their length.  An empty table gives no rows.
    """
    scanned = saved(scan(docs, id_col, text_col, span), "runs")
    seen = scanned.select("key", "n_bytes", F.explode(F.arrays_zip("h", "first", "size")).alias("r"))
    twice = scanned.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    places = seen.select("key", "n_bytes", F.col("r.h").alias("h"), (F.col("r.first") * PLACE + F.col("r.size")).alias("place"))
    again = saved(
        places.join(twice, "h", "left_semi").unionByName(places.where(F.pmod("place", F.lit(PLACE)) >= TWICE)).groupBy("key", "n_bytes").agg(F.collect_set(F.struct("h", "place")).alias("runs")), "again").withColumnsRenamed(
            {"key": "_key", "n_bytes": "_size"}).hint("shuffle_hash")

    raw = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_t"))
    raw = raw.withColumns({"key": F.xxhash64("_t"), "n_bytes": F.length("_t").cast("bigint")})
    texts = saved(raw.join(again, (F.col("key") == F.col("_key")) & (F.col("n_bytes") == F.col("_size"))).drop("_key", "_size"), "texts")
    placed = texts.select("key", "n_bytes", F.explode(F.transform("runs", lambda r: F.struct(
        r["h"].alias("h"), F.floor(r["place"] / PLACE).alias("first"),
        F.substring("_t", F.floor(r["place"] / PLACE).cast("int") + 1, (r["place"] % TWICE).cast("int") + span - 1).alias("data")))).alias("r")).select(
        "key", "n_bytes", "r.h", "r.first", F.xxhash64("r.data").alias("block"), "r.data")
    blocks = saved(placed.groupBy("h", "block").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n")), "blocks")
    hot = blocks.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot_blocks).select("h")
    hot = saved(hot, "hot")
    if hot.isEmpty():
        pieces = sort_blocks(blocks, span)
    else:
        pieces = sort_blocks(blocks.join(hot, "h", "left_anti"), span).unionByName(match_windows(blocks.join(hot, "h", "left_semi"), span))
    found = (
        placed.select("key", "n_bytes", "h", "block", "first").distinct().join(saved(pieces, "pieces"), ["h", "block"])
        .select("key", "n_bytes", F.explode("pieces").alias("p"), "first")
        .groupBy(F.col("key").alias("_key"), F.col("n_bytes").alias("_size"))
        .agg(F.collect_list(F.struct((F.col("first") + F.col("p.a")).alias("a"), (F.col("first") + F.col("p.b")).alias("b"))).alias("pieces"))
    ).hint("shuffle_hash")
    joined = texts.join(found, (F.col("key") == F.col("_key")) & (F.col("n_bytes") == F.col("_size")), "left").select("_id", "n_bytes", "_t", "pieces")

    def remove(batches):
        for batch in batches:
            out = [_without(t.as_buffer().to_pybytes(), p.as_py() or []) for t, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([len(o[1]) for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.string()), pa.array([o[1] for o in out], ARROW_PIECES), pa.array([o[3] for o in out], pa.binary())],
                names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    id_type = dict(texts.dtypes)["_id"]
    cut = joined.mapInArrow(
        remove, f"_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed {PIECES}, kept binary")
    whole = scanned.join(again, (F.col("key") == F.col("_key")) & (F.col("n_bytes") == F.col("_size")), "left_anti").select(
        "_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.col("sha").alias("kept_sha256"), F.array().cast(PIECES).alias("removed"), F.lit(None).cast("binary").alias("kept"))
    return whole.unionByName(cut)


def _without(text: bytes, pieces: list[dict]) -> tuple[int, list[dict], str, bytes | None]:
    merged: list[dict] = []
    for p in sorted(pieces, key=lambda p: p["a"]):
        if merged and p["a"] <= merged[-1]["b"]:
            merged[-1]["b"] = max(merged[-1]["b"], p["b"])
        else:
            merged.append(dict(p))
    edges = [0, *[x for p in merged for x in (p["a"], p["b"])], len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return len(text) - len(kept), merged, hashlib.sha256(kept).hexdigest(), kept if merged else None
