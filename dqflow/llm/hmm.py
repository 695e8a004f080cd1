"""Operator 5: hidden Markov language model over all training words, Baum-Welch over partitions, scaled forward likelihood."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.llm.common import dropped, released, saved, ship

ship(__name__)

#: Lower-cases A-Z and leaves all other bytes.
TO_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: The end token: no word holds a blank.
END = b" "
SHAPES = 64
UNKNOWN = 0xFFFFFFFF
TOKENS_AT_ONCE = 1_000_000
#: Tokens of one stored chunk of texts: many texts run through the recursions side by side.
CHUNK = 1_000_000
#: Baum-Welch ends when a step raises the log likelihood by less than this share of it.
TOLERANCE = 2e-3
#: Baum-Welch over all texts starts from the counts of neighbouring words of all training texts: the most frequent
#: words stand for themselves there, all others by shape.  The tolerance and steps of fitting the states to these counts.
START_WORDS, START_TOLERANCE, START_STEPS = 1_000, 1e-6, 300
#: The texts learned from are scored in so many parts, one after the other.
SCORED_IN = 2


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split(), END]


def shape_of(word: bytes) -> int:
    """Class of a word outside the vocabulary: its length in bytes up to 16 and the most special kind of byte."""
    kind = 3 if not word.isascii() else 0 if word.isalpha() else 1 if word.isalnum() else 2
    return (min(len(word), 16) - 1) * 4 + kind


def _hash(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64).view(np.int64)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch of texts, as ``tokens_of`` has them, without a Python object for each: hashes and shapes of the
    different ones, then the number of every token, text by text, and where the texts begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = lists.flatten().dictionary_encode()
    words = pieces.dictionary.cast(pa.large_binary())
    # A blank at either side of a text leaves an empty piece: none of them is a word, so the end takes their number.
    void = pc.index(words, pa.scalar(b"", words.type)).as_py()
    places, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset:][:len(words) + 1].tolist(), words.buffers()[2]
    data = data.to_pybytes() if data else b""
    named = [data[a:b] for a, b in zip(places, places[1:])]
    end = len(named) if void < 0 else void
    named[end:end + 1] = [END]
    number = pieces.indices.to_numpy(zero_copy_only=False)
    kept = number != end
    ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])]
    flat = np.full(int(ends[-1]) + len(texts), end, np.int32)
    # A word stands as many places further on as texts end before it.
    flat[np.arange(ends[-1]) + np.repeat(np.arange(len(texts)), np.diff(ends))] = number[kept]
    return _hash(named), _shapes(named), flat, ends + np.arange(len(ends))


def _shapes(words: list[bytes]) -> np.ndarray:
    """``shape_of`` of many words."""
    own = pa.array(words, pa.binary())
    length = np.minimum(pc.binary_length(own).to_numpy(), 16)
    own = own.cast(pa.string())
    plain, letters, either = (f(own).to_numpy(zero_copy_only=False) for f in (pc.string_is_ascii, pc.ascii_is_alpha, pc.ascii_is_alnum))
    return (length - 1) * 4 + np.where(~plain, 3, np.where(letters, 0, np.where(either, 1, 2)))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """h, shape, c: how often each distinct token occurs; words travel as 64-bit hashes with their shape."""
    def count(batches):
        for batch in batches:
            if batch.num_rows:
                h, shape, flat, _ = numbered(batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(shape, pa.int32()), pa.array(np.bincount(flat, minlength=len(h)), pa.int64())], names=["h", "shape", "c"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(count, "h bigint, shape int, c bigint").groupBy("h", "shape").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words: sorted hashes, counts and codes (``UNKNOWN`` for words whose emissions stay in Spark).

    ``rest`` has h, c and shape of all training words without a code; ``unseen`` is the probability, in every state, of
    one word that is not in training, by shape, and ``seen`` what is left for the training words.
    """

    hashes: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    size: int
    tokens: int
    distinct: int
    coded_hashes: np.ndarray
    coded_counts: np.ndarray
    coded_shapes: np.ndarray
    unseen: np.ndarray
    seen: float
    rest: DataFrame | None


def vocabulary(counts: DataFrame, words: int, frequent: int) -> Vocabulary:
    """Emissions of the ``words`` most frequent words travel with the tasks, all others are rows of a table; counts of
    words above 1/``frequent`` of all tokens, ``frequent`` at most, are held at hand."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(_hash([END])[0])
    known = counts.where((F.col("c") > total / frequent) | (F.col("h") == end)).select("h", "c").toPandas()
    top = counts.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(words).select("h", "c", "shape").toPandas()
    own = [end, *top["h"].tolist()]
    place = {h: i for i, h in enumerate(own)}
    hashes, held = known["h"].to_numpy(np.int64), known["c"].to_numpy(np.int64)
    at_hand = set(hashes.tolist())
    missing = [(h, c) for h, c in zip(top["h"].tolist(), top["c"].tolist()) if h not in at_hand]
    if missing:
        hashes, held = np.append(hashes, [m[0] for m in missing]), np.append(held, [m[1] for m in missing])
    if end not in at_hand:
        hashes, held = np.append(hashes, end), np.append(held, 0)
    order = np.argsort(hashes)
    hashes, held = hashes[order].astype(np.int64), held[order].astype(np.int64)
    codes = np.array([place.get(h, UNKNOWN) for h in hashes.tolist()], np.uint32)
    # The rows after the last coded one in the same order.
    last, least = (int(top["h"].iloc[-1]), int(top["c"].iloc[-1])) if len(top) else (-(1 << 63), 1 << 62)
    rest = counts.where((F.col("h") != end) & ((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last)))).select("h", "c", "shape")
    n, v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.where(F.col("h") != end).groupBy("shape").agg(F.count_if(F.col("c") == 1).alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["shape"]], v[r["shape"]] = r["n"], r["v"]
    # Good-Turing: unseen words of a shape are as likely together as its words met once; as many are taken as it has, and one.
    mass = (n + 0.5) / (total + 0.5 + (n + 0.5).sum())
    own_count = dict(zip(hashes.tolist(), held.tolist()))
    return Vocabulary(hashes, held, codes, len(own) + SHAPES, int(total), int(distinct), np.array(own, np.int64),
                      np.array([own_count.get(h, 0) for h in own], float), np.array([shape_of(END), *top["shape"].tolist()]), mass / (v + 1), float(1 - mass.sum()), rest)


def encode(docs: DataFrame, text_col: str, vocab: Vocabulary) -> DataFrame:
    """Each row with its codes (obs), row number, n_tokens, the sums over words at hand, the hashes of words whose count
    is not at hand (rare) and of those without a code (far, which have their shape's code)."""
    # Arrays only: workers need not know the classes of this package.
    shared = docs.sparkSession.sparkContext.broadcast((vocab.hashes, vocab.counts, vocab.codes))
    first_shape = vocab.size - SHAPES
    own = "_row bigint, n_tokens bigint, _known bigint, _logs double, obs binary, rare array<bigint>, far array<bigint>"
    place = docs.columns.index(text_col)
    keep = [i for i, c in enumerate(docs.columns) if c != text_col]

    def code(batches):
        (hashes, counts, codes), row = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            h, shape, flat, ends = numbered(batch.column(place))
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[at] == h
            count, named = np.where(hit, counts[at], -1), np.where(hit, codes[at], UNKNOWN)
            obs_of = np.where(named == UNKNOWN, first_shape + shape, named).astype(np.int32)
            log_of = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
            starts = ends[:-1]
            obs, far = obs_of[flat], count[flat] < 0
            rare_h, rare_ends = h[flat[far]], np.concatenate([[0], np.cumsum(far)])[ends]
            plain = obs >= first_shape
            far_h, far_ends = h[flat[plain]], np.concatenate([[0], np.cumsum(plain)])[ends]
            cut = [obs[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(np.arange(row, row + len(starts))), pa.array(np.diff(ends).astype(np.int64)),
                 pa.array(np.add.reduceat((count[flat] > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(log_of[flat], starts)),
                 pa.array(cut, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(rare_ends.astype(np.int32)), pa.array(rare_h)),
                 pa.ListArray.from_arrays(pa.array(far_ends.astype(np.int32)), pa.array(far_h))],
                names=[*[batch.schema.names[i] for i in keep], *[f.split()[0] for f in own.split(", ")]])
            row += len(starts)

    kept = [docs.columns[i] for i in keep]
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in kept)
    return docs.mapInArrow(code, f"{schema}, {own}")


@dataclass
class Model:
    """start[k], move[k, k], emit[k, class]; far has h and x0, x1, ..., the expected counts of words without a code.

    A far word has the probability ``scale[k] * (x_k + c / tokens)``, c being the sum of its x.  While words without a
    code are tied by shape, ``tied[k, shape]`` is the sum of that over the shape, shared out by c.
    """

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    tied: np.ndarray | None = None
    far: DataFrame | None = None
    scale: np.ndarray | None = None


def shares_of(h: np.ndarray, states: int, seed: int) -> np.ndarray:
    """A random point of the simplex for each hash, evenly spread: how its first counts are dealt to the states."""
    own = [(k * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % 2**64 for k in range(1, states + 1)]
    z = h.view(np.uint64)[:, None] + np.array(own, np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 1e-12)
    return x / x.sum(axis=1, keepdims=True)


def _names(states: int) -> list[str]:
    return [f"x{k}" for k in range(states)]


def _emissions(vocab: Vocabulary, counts: np.ndarray, all_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions of the coded words from their expected counts and those of all words, and the scale of the far words."""
    base = vocab.coded_counts / (vocab.tokens + 0.5)
    base[0] += 0.5 / (vocab.tokens + 0.5)
    scale = vocab.seen / (all_counts + 1)
    return (counts + base) * scale[:, None], scale


class Start(NamedTuple):
    """Where Baum-Welch over all texts begins: how the counts of words (sorted hashes) and of shapes are dealt to the states."""

    start: np.ndarray
    move: np.ndarray
    hashes: np.ndarray
    shares: np.ndarray
    of_shape: np.ndarray

    def deal(self, h: np.ndarray, c: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        x = self.of_shape[shape]
        x[known] = self.shares[at[known]]
        return x * c[:, None]


def neighbours(coded: DataFrame, vocab: Vocabulary, words: int) -> np.ndarray:
    """How often a class follows another in all training texts; the last row counts the classes that texts begin with.

    Classes are the end and the ``words`` most frequent words, then the shapes: a table of bounded size, whatever the input.
    """
    own = min(words + 1, vocab.size - SHAPES)
    classes = own + SHAPES
    class_of = np.concatenate([np.arange(own), own + vocab.coded_shapes[own:], np.arange(own, classes)]).astype(np.int64)
    shared = coded.sparkSession.sparkContext.broadcast(class_of)

    def count(batches):
        of, sums = shared.value, np.zeros((classes + 1) * classes, np.int64)
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(0)]
            if not sequences:
                continue
            after = of[np.concatenate(sequences)]
            before = np.concatenate([[classes], after[:-1]])
            before[np.cumsum([0, *[len(x) for x in sequences[:-1]]])] = classes
            sums += np.bincount(before * classes + after, minlength=len(sums))
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["pair", "c"])

    found = coded.where(~F.col("held_out")).select("obs").mapInArrow(count, "pair bigint, c bigint").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros((classes + 1) * classes)
    out[found["pair"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(classes + 1, classes)


def starting_point(coded: DataFrame, vocab: Vocabulary, states: int, seed: int) -> Start:
    """The states fitted to the neighbouring words of all training texts, by expectation and maximisation on their counts.

    A neighbouring pair (u, v) has the probability of the sum of p_k emit_k(u) move_kl emit_l(v); the counts of all pairs are
    all that the steps need.  Words outside the classes start with the shares of their shape.
    """
    counts = neighbours(coded, vocab, START_WORDS)
    begins, pairs = counts[-1], counts[:-1]
    classes = len(pairs)
    own = classes - SHAPES
    names = np.concatenate([vocab.coded_hashes[:own], np.arange(SHAPES)])
    base = (begins + pairs.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * classes)
    rng = np.random.default_rng(seed)
    move = rng.dirichlet(np.ones(states), states) + np.eye(states)
    move /= move.sum(1, keepdims=True)
    emit = (shares_of(names, states, seed) * base[:, None]).T
    emit /= emit.sum(1, keepdims=True)
    of, used, last = np.full(states, 1 / states), emit * base, None
    for _ in range(START_STEPS):
        if not pairs.any():
            break
        first = of[:, None] * emit
        chance = first.T @ move @ emit
        ratio = pairs / np.maximum(chance, 1e-300)
        reached = float((pairs * np.log(np.maximum(chance, 1e-300))).sum())
        stands = first * ((move @ emit) @ ratio.T)
        used = stands + emit * ((move.T @ first) @ ratio)
        moves = move * (first @ ratio @ emit.T)
        of = (stands.sum(axis=1) + 0.1) / (stands.sum() + 0.1 * states)
        move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
        emit = used + base
        emit /= emit.sum(1, keepdims=True)
        if last is not None and reached - last < START_TOLERANCE * abs(last):
            break
        last = reached
    likely = of[:, None] * emit
    start = (likely / likely.sum(axis=0) * begins).sum(axis=1) + 0.1
    shares = used.T + (used.sum(axis=1) / max(used.sum(), 1e-300))[None, :] * 1e-3 + 1e-12
    shares /= shares.sum(axis=1, keepdims=True)
    order = np.argsort(names[:own])
    return Start(start / start.sum(), move, names[:own][order], shares[:own][order], shares[own:])


def first_model(coded: DataFrame, vocab: Vocabulary, states: int, seed: int) -> tuple[Model, np.ndarray, float]:
    """Every word's count dealt to the states by the starting point's shares; also the counts of far words by shape
    and the log10 of how those share them out."""
    begin = starting_point(coded, vocab, states, seed)
    shared = coded.sparkSession.sparkContext.broadcast(tuple(begin))
    names = ["c", "own", *_names(states)]

    def deal(batches):
        known, sums = Start(*shared.value), np.zeros((SHAPES, 2 + states))
        for batch in batches:
            h, c, shape = (batch.column(i).to_numpy() for i in range(3))
            x = np.column_stack([c, c * np.log10(c), known.deal(h, c, shape)])
            sums += np.stack([np.bincount(shape, weights=x[:, k], minlength=SHAPES) for k in range(2 + states)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPES)), *[pa.array(v) for v in sums.T]], names=["shape", *names])

    total = vocab.rest.select("h", "c", "shape").mapInArrow(deal, ", ".join(["shape bigint", *[f"{n} double" for n in names]])).groupBy("shape").agg(
        *[F.sum(n).alias(n) for n in names]).toPandas()
    sums = np.zeros((SHAPES, 2 + states))
    sums[total["shape"].to_numpy(np.intp)] = total[names].to_numpy(float)
    of_shape, far = sums[:, 0], sums[:, 2:].T
    counts = begin.deal(vocab.coded_hashes, vocab.coded_counts, vocab.coded_shapes).T
    emit, scale = _emissions(vocab, counts, counts.sum(axis=1) + far.sum(axis=1))
    dealt_out = float(sums[:, 1].sum() - (of_shape * np.log10(np.maximum(of_shape, 1))).sum())
    return Model(begin.start, begin.move, emit, _tied(vocab, far, of_shape, scale), scale=scale), of_shape, dealt_out


def _tied(vocab: Vocabulary, far: np.ndarray, of_shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (far + of_shape / (vocab.tokens + 0.5)) * scale[:, None]


def chunked(coded: DataFrame, first_shape: int) -> DataFrame:
    """Texts laid together, about ``CHUNK`` tokens a row: their numbers, lengths and codes, and the different far words."""
    def lay(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            sequences = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
            # Texts of like length share a chunk: the recursions take as many steps as the longest one has tokens.
            order = np.argsort([len(x) for x in sequences], kind="stable")
            row, sequences = batch.column(0).to_numpy()[order], [sequences[i] for i in order]
            held = batch.column(2).take(pa.array(order))
            far, ends = held.flatten().to_numpy(), np.cumsum([0, *held.value_lengths().to_pylist()])
            lengths, out, at = np.array([len(x) for x in sequences]), [], 0
            while at < len(sequences):
                to = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK, side="right")) + at)
                flat, mine = np.concatenate(sequences[at:to]), far[ends[at]:ends[to]]
                plain = flat >= first_shape
                words, first, inverse = np.unique(mine, return_index=True, return_inverse=True)
                shapes = (flat[plain][first] - first_shape).astype(np.uint8)
                flat[plain] = first_shape + inverse
                out.append((number, row[at:to].astype(np.int64).tobytes(), lengths[at:to].astype(np.int32).tobytes(), flat.tobytes(), shapes.tobytes(), words))
                number, at = number + 1, to
            if out:
                kinds = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                                 names=["chunk", "rows", "lengths", "obs", "shapes", "words"])

    return coded.select("_row", "obs", "far").mapInArrow(
        lay, "chunk bigint, rows binary, lengths binary, obs binary, shapes binary, words array<bigint>")


def _opened(batch, i: int):
    """Row numbers, sequences, and the shapes and hashes of the chunk's far words."""
    rows, lengths, obs, shapes, words = (batch.column(c)[i] for c in range(5))
    ends = np.cumsum(np.frombuffer(lengths.as_py(), np.int32))
    sequences = np.split(np.frombuffer(obs.as_py(), np.int32), ends[:-1])
    return np.frombuffer(rows.as_py(), np.int64), sequences, np.frombuffer(shapes.as_py(), np.uint8), words.values.to_numpy()


def _with_words(m: Model, far: np.ndarray) -> Model:
    return Model(m.start, m.move, np.concatenate([m.emit, far], axis=1))


def batches_by_length(sequences: list[np.ndarray]):
    """Indices of sequences, longest first, cut so that a batch holds about ``TOKENS_AT_ONCE`` tokens."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    out, size = [], 0
    for i in order:
        out.append(i)
        size += len(sequences[i])
        if size >= TOKENS_AT_ONCE:
            yield out
            out, size = [], 0
    if out:
        yield out


def _lay_out(sequences: list[np.ndarray]):
    """Observations step by step over all sequences (longest first), where each step begins, and how many are active."""
    lengths = np.array([len(s) for s in sequences])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    begin = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate(sequences).astype(np.intp)
    step = np.concatenate([np.arange(n) for n in lengths])
    return flat, begin, active, begin[step] + np.repeat(np.arange(len(lengths)), lengths)


def forward(sequences: list[np.ndarray], m: Model, keep=False):
    """log10 likelihood of each sequence (longest first) by the scaled forward recursion; with ``keep`` all scaled alphas too.

    States are rows and sequences columns, so that every operation runs along many sequences.
    """
    flat, begin, active, where = _lay_out(sequences)
    obs = np.empty(len(flat), np.intp)
    obs[where] = flat
    # ``take`` would copy emissions that lie in any other order at every step.
    emit, onward = np.ascontiguousarray(m.emit), np.ascontiguousarray(m.move.T)
    alphas, scales = np.empty((len(m.start), len(flat))) if keep else None, np.empty(len(flat))
    a = m.start[:, None] * emit.take(obs[: begin[1]], axis=1)
    for t in range(len(active)):
        lo, hi = begin[t], begin[t + 1]
        if t:
            a = onward @ a[:, : active[t]]
            a *= emit.take(obs[lo:hi], axis=1)
        s = a.sum(axis=0)
        a /= s
        scales[lo:hi] = s
        if keep:
            alphas[:, lo:hi] = a
    lengths = [len(s) for s in sequences]
    total = np.add.reduceat(np.log10(scales)[where], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return total, (obs, begin, active, alphas, scales)


def expectations(sequences: list[np.ndarray], m: Model) -> tuple[Model, float]:
    """Expected counts of starts, moves and emissions, and the log10 likelihood."""
    total, (obs, begin, active, gamma, scales) = forward(sequences, m, keep=True)
    emit, move, beta = np.ascontiguousarray(m.emit), np.zeros_like(m.move), np.ones((len(m.start), active[-1]))
    for t in range(len(active) - 2, -1, -1):
        lo, hi, n = begin[t], begin[t + 1], active[t + 1]
        after = emit.take(obs[hi:begin[t + 2]], axis=1)
        after *= beta
        after /= scales[hi:begin[t + 2]]
        move += gamma[:, lo:lo + n] @ after.T
        gamma[:, hi:begin[t + 2]] *= beta
        beta = np.ones((len(m.start), active[t]))
        np.matmul(m.move, after, out=beta[:, :n])
    gamma[:, : begin[1]] *= beta
    counts = np.stack([np.bincount(obs, weights=g, minlength=emit.shape[1]) for g in gamma])
    return Model(gamma[:, : begin[1]].sum(axis=1), move * m.move, counts), float(total.sum())


def train(coded: DataFrame, vocab: Vocabulary, states: int, steps: int | None, seed: int, tolerance=TOLERANCE,
          chunks: DataFrame | None = None, first: tuple | None = None) -> tuple[Model, list[float]]:
    """Baum-Welch until a step gains less than ``tolerance`` of the log likelihood, or for ``steps`` if given, then a last step.

    Up to there the words without a code are tied: those of one shape share their states' shares, so a step only sends
    the sums of codes and shapes, whatever the number of words.  The last step unties them: it gives each word the
    expected counts of its own occurrences, a table of (h, x0, x1, ...) summed by hash.  Neither kind of step can
    lower the likelihood.
    """
    first_shape = vocab.size - SHAPES
    chunks = saved(chunked(coded, first_shape), "chunks", "zstd") if chunks is None else chunks
    (model, of_shape, dealt_out), history = first or first_model(coded, vocab, states, seed), []
    names = _names(states)
    kind = ", ".join(["far boolean", "k bigint", *[f"{x} double" for x in names]])

    def rows_of(far, k, x):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), far)), pa.array(k), *[pa.array(np.ascontiguousarray(c)) for c in x]],
                                          names=["far", "k", *names])

    def passed(model: Model, untied: bool) -> DataFrame:
        """Sums of expected counts: below the codes the start, the likelihood, all counts and the moves from each state;
        then codes and shapes; with ``untied`` the far words instead of the shapes."""
        shared = coded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, model.tied))

        def count(batches):
            m, likelihood, every = Model(*shared.value), 0.0, np.zeros(states)
            sums = Model(np.zeros(states), np.zeros((states, states)), np.zeros((states, first_shape + SHAPES)))
            for batch in batches:
                for i in range(batch.num_rows):
                    _, sequences, shapes, words = _opened(batch, i)
                    if not untied:
                        of = np.concatenate([np.arange(first_shape), first_shape + shapes.astype(np.int32)])
                        sequences = [of[x] for x in sequences]
                    here = _with_words(m, m.tied[:, shapes] if untied else m.tied)
                    far = np.zeros((states, len(words)))
                    for part in batches_by_length(sequences):
                        got, ll = expectations([sequences[j] for j in part], here)
                        likelihood += ll
                        every += got.emit.sum(axis=1)
                        sums.start += got.start
                        sums.move += got.move
                        if untied:
                            sums.emit[:, :first_shape] += got.emit[:, :first_shape]
                            far += got.emit[:, first_shape:]
                        else:
                            sums.emit += got.emit
                    if untied and len(words):
                        yield rows_of(True, words, far)
            own = np.column_stack([sums.start, np.full(states, likelihood), every, sums.move.T, sums.emit])
            yield rows_of(False, np.arange(-3 - states, first_shape + SHAPES), own)

        return saved(chunks.select("rows", "lengths", "obs", "shapes", "words").mapInArrow(count, kind).groupBy("far", "k").agg(
            *[F.sum(x).alias(x) for x in names]), "step")

    def improved(model: Model, untied: bool) -> tuple[Model, float]:
        step = passed(model, untied)
        sums = step.where(~F.col("far")).toPandas()
        values = np.zeros((states, 3 + states + first_shape + SHAPES))
        values[:, sums["k"].to_numpy(np.intp) + 3 + states] = sums[names].to_numpy(float).T
        start, move = values[:, 0] + 0.1, values[:, 3:3 + states] + 0.1
        coded_part, shape_part = np.split(values[:, 3 + states:], [first_shape], axis=1)
        emit, scale = _emissions(vocab, coded_part, values[:, 2])
        far = step.where("far").withColumnRenamed("k", "h").drop("far") if untied else None
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit, _tied(vocab, shape_part, of_shape, scale), far, scale), float(values[0, 1])

    while steps is None or len(history) < steps:
        model, reached = improved(model, False)
        history.append(reached + dealt_out)
        released(coded.sparkSession)
        if not reached or (steps is None and len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-2])):
            break
    return improved(model, True)[0], history


def _far_emissions(chunks: DataFrame, m: Model, vocab: Vocabulary) -> DataFrame:
    """_chunk, met (array<struct<pos, x0, x1, ...>>): the emissions of the far words of each chunk."""
    names = _names(len(m.start))
    total = sum((F.col(x) for x in names[1:]), F.col(names[0]))
    # Single precision is enough for one factor of a text's probability, and halves what travels.
    emitted = m.far.select("h", *[((F.col(x) + total / (vocab.tokens + 0.5)) * float(m.scale[k])).cast("float").alias(x) for k, x in enumerate(names)])
    return chunks.select(F.col("chunk").alias("_chunk"), F.posexplode("words").alias("pos", "h")).join(emitted, "h").groupBy("_chunk").agg(
        F.collect_list(F.struct("pos", *names)).alias("met"))


def likelihoods(chunks: DataFrame, model: Model, vocab: Vocabulary) -> DataFrame:
    """_at (row number), score."""
    shared, unseen = chunks.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit)), vocab.unseen
    met = _far_emissions(chunks, model, vocab)

    def work(batches):
        m = Model(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row, sequences, shapes, _ = _opened(batch, i)
                far, found = np.tile(unseen[shapes], (len(m.start), 1)), batch.column(5)[i]
                if found.is_valid and len(found.values):
                    parts = found.values.flatten()
                    far[:, parts[0].to_numpy()] = np.stack([x.to_numpy() for x in parts[1:]])
                here, out = _with_words(m, far), np.zeros(len(row))
                for part in batches_by_length(sequences):
                    out[part] = forward([sequences[j] for j in part], here)[0]
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(out)], names=["_at", "score"])

    joined = chunks.join(met, F.col("chunk") == F.col("_chunk"), "left").select("rows", "lengths", "obs", "shapes", "words", "met")
    return joined.mapInArrow(work, "_at bigint, score double")


def score_texts(docs: DataFrame, id_col="doc_id", text_col="text", states=4, steps=None, words=50_000, frequent=2_000_000, seed=7,
                tolerance=TOLERANCE) -> DataFrame:
    """_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    The model learns from rows whose crc32(id as text) mod 7 is not 2 (a null id is learned from), until a Baum-Welch
    step over all of them gains less than ``tolerance`` of the log likelihood (``steps`` steps if given); it starts from
    the counts of neighbouring words of all of them.  Every training word and the end is a symbol with
    emissions of its own: those of the ``words`` most frequent are learned in every step and travel with the tasks; all
    others are tied by shape until the last step, which counts for each of them alone, and are joined by hash to be
    scored.  A word outside training has its share of its shape's unseen mass, the same in every state.
    ``score`` is the exact log10 likelihood of the token sequence.  Counts of words above 1/``frequent`` of the tokens,
    so at most ``frequent`` words, travel with the tasks; all others are joined by hash, none of them being hot.
    Null and empty texts are the end token alone.  Repeated rows are scored and learned from each.  Without
    training rows all counts are 0 and the first model stands.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("_t"))
    counts = saved(word_counts(rows.where(~F.col("held_out")), "_t"), "counts")
    vocab = vocabulary(counts, words, frequent)
    coded = saved(encode(rows, "_t", vocab), "coded", "zstd")
    rare = counts.where(F.col("c") <= vocab.tokens / frequent).select("h", "c")
    far = (
        coded.select("_row", F.explode("rare").alias("h")).join(rare, "h")
        .groupBy(F.col("_row").alias("_of")).agg(F.sum(F.log10(F.col("c") + 1.0)).alias("_far"), F.count(F.lit(1)).alias("_found"))
    )
    own = saved(coded.select("_id", "held_out", "_row", "n_tokens", "_known", "_logs").join(far, F.col("_row") == F.col("_of"), "left").select(
        "_id", "held_out", "_row", "n_tokens", (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("_far", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(vocab.tokens + vocab.distinct + 1)))).alias("base_score")), "base")
    first_shape = vocab.size - SHAPES
    learned, others = (saved(chunked(coded.where(F.col("held_out") == held), first_shape), "chunks", "zstd") for held in (False, True))
    first = first_model(coded, vocab, states, seed)
    # What only the start needed leaves the disk before the passes.
    dropped(coded)
    dropped(counts)
    released(docs.sparkSession)
    model, _ = train(learned, vocab, states, steps, seed, tolerance, learned, first)
    # Chunk numbers are unique among the texts learned from and among the others, not over both.  The texts learned from
    # are scored part by part: only one part's far words lie in shuffle files at a time.
    slice_of, scored = F.pmod(F.xxhash64("chunk"), F.lit(SCORED_IN)), []
    for part in (others, *[learned.where(slice_of == i) for i in range(SCORED_IN)]):
        released(docs.sparkSession)
        scored.append(saved(likelihoods(part, model, vocab), "scores"))
    return own.join(reduce(DataFrame.unionByName, scored), F.col("_row") == F.col("_at")).select(
        "_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
