"""Operator 4: benchmark decontamination by Wu-Manber multi-pattern search on words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import saved, ship, text_of, without
from dqflow.operators.skew import join_unique

ship(__name__)

#: Bytes of words: digits, letters (A-Z lower-cased) and everything beyond ASCII; all others separate.
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: The same words as a pattern for Spark's own count.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = "hash bigint, size int, runs array<struct<start:bigint,end:bigint>>, items array<string>"
HITS_ARROW = pa.schema([("hash", pa.int64()), ("size", pa.int32()), ("runs", RUNS), ("items", pa.list_(pa.string()))])
FOUND = "hash bigint, size int, n_hit bigint, n_items bigint, items_sha256 string, hits array<struct<start:bigint,end:bigint>>"
FOUND_ARROW = pa.schema([("hash", pa.int64()), ("size", pa.int32()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                         ("items_sha256", pa.string()), ("hits", RUNS)])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Matcher:
    """Wu-Manber tables for patterns of one length, with words as the alphabet.

    A block is the last two words of a window (one where patterns have one word).  ``shift`` says how far a
    window may move when its block is no end of a pattern; blocks in no pattern move it by the most.
    At shift 0 the hash of the block selects the bucket whose patterns are compared directly.
    """

    def __init__(self, length: int, patterns: dict[tuple, list]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                block = p[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.most), length - end)
            self.bucket.setdefault(p[length - self.block:], []).append((p, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of all occurrences."""
        size, n, shift, most = self.length, len(words), self.shift, self.most
        end, pairs = size, self.block == 2
        while end <= n:
            block = (words[end - 2], words[end - 1]) if pairs else (words[end - 1],)
            step = shift.get(block, most)
            if step:
                end += step
                continue
            window = tuple(words[end - size:end])
            for pattern, items in self.bucket[block]:
                if pattern == window:
                    yield end - size, items
            end += 1


def matchers(items: list[tuple], length: int) -> list[Matcher]:
    """One matcher per pattern length: ``length`` words, and whole items that are shorter."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, words in items:
        size = min(length, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(words[i:i + size]), [])
            if item not in owners:
                owners.append(item)
    return [Matcher(n, p) for n, p in sorted(by_length.items())]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> tuple[DataFrame, int]:
    """The items that have words, stored with the number of their block, and the number of blocks.

    Hashes deal the items, so a block holds about ``block_words`` words and never much more than that and its longest item.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.regexp_count("words", F.lit(WORDS)))).first()[0] or 0
    blocks = -(-total // block_words)
    return saved(items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1)))), "items"), blocks


def block_hits(docs: DataFrame, text_col: str, items: list[tuple], length: int, number: int) -> DataFrame:
    """hash, size, runs (merged, in words), items and block of each document that holds a window of ``items``; stored."""
    block = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches):
        loaded = matchers(block.value, length)
        for batch in batches:
            out = []
            for h, size, text in zip(*[c.to_pylist() for c in batch.columns]):
                words, covered, owners = words_of(text), [], set()
                for m in loaded:
                    for start, of in m.search(words):
                        covered.append((start, start + m.length))
                        owners.update(of)
                if covered:
                    out.append({"hash": h, "size": size, "runs": [{"start": a, "end": b} for a, b in merged(covered)], "items": sorted(owners)})
            yield pa.RecordBatch.from_pylist(out, HITS_ARROW)

    t = text_of(text_col)
    found = docs.select(F.xxhash64(t).alias("hash"), F.length(t).alias("size"), t.alias("text")).mapInArrow(search, HITS)
    out = saved(found.withColumn("block", F.lit(number)), f"hits{number}")
    block.destroy()
    return out


def text_hits(hits: DataFrame) -> DataFrame:
    """The results per text, runs and items of its blocks put together; equal texts have equal hits in a block."""
    lists = hits.dropDuplicates(["block", "hash", "size"]).groupBy("hash", "size").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def joined(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                runs = merged([(x["start"], x["end"]) for x in r["runs"]])
                out.append({
                    "hash": r["hash"], "size": r["size"], "n_hit": sum(b - a for a, b in runs), "n_items": len(r["items"]),
                    "items_sha256": hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(),
                    "hits": [{"start": a, "end": b} for a, b in runs]})
            yield pa.RecordBatch.from_pylist(out, FOUND_ARROW)

    return lists.mapInArrow(joined, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text_col="text",
                  length=10, block_words=2_000_000) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and hits (start, end in words of merged runs).

    The benchmark is stored in blocks of about ``block_words`` words.  One pass over the documents searches one
    block, which is the only one that the driver and the executors hold; its hits are written, and those of
    all blocks are put together per text (64-bit hash and length).  Items with the same words all count.
    Null and empty texts have no words; null or empty items have no windows; a null item id counts as an
    empty one.  Repeated rows stay, columns named like the results are replaced, empty tables on either
    side give no rows or no hits.
    """
    spark = docs.sparkSession
    stored, blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    passes = []
    for b in range(blocks):
        items = [(r["item"], words_of(r["words"])) for r in stored.where(F.col("block") == b).toLocalIterator()]
        passes.append(block_hits(docs, text_col, items, length, b))
    none = spark.createDataFrame([], f"{HITS}, block int")
    found = saved(text_hits(reduce(DataFrame.unionByName, passes, none)), "text-hits").withColumnsRenamed({"hash": "_hash", "size": "_size"})
    t = text_of(text_col)
    kept = without(docs, "n_words", "contaminated", "_hash", "_size", *FOUND_ARROW.names[2:]).withColumns({"_hash": F.xxhash64(t), "_size": F.length(t)})
    met = join_unique(kept, found, ["_hash", "_size"], "left", source=kept.select("_hash", "_size")).drop("_hash", "_size")
    return met.withColumns({
        "n_words": F.regexp_count(t, F.lit(WORDS)).cast("bigint"),
        "n_hit": F.coalesce("n_hit", F.lit(0).cast("bigint")), "n_items": F.coalesce("n_items", F.lit(0).cast("bigint")),
        "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "contaminated": F.col("n_hit").isNotNull(),
        "hits": F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint>>")),
    })


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
